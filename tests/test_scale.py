"""Steps whose cost must follow their input: what they give and what their plans do."""

import random
from datetime import date

from tallyspark.operators import allocation, audit, ledger, posting, templates


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_fifo_writes_once_and_follows_a_hot_party_over_ranges(spark, monkeypatch):
    rnd = random.Random(1)
    party = lambda: rnd.choice([1, 1, 1, 2, 3, None, rnd.randrange(20)])
    day = lambda: date(2026, 1, rnd.randrange(1, 31))
    invoices = [("SATIS", party(), n, day(), rnd.randrange(50)) for n in range(500)]
    receipts = [("SATIS", party(), n, day(), rnd.randrange(60)) for n in range(400)]
    left, want = {i[2]: i[4] for i in invoices}, {}
    for _, who, id_, on, rest in sorted((r for r in receipts if r[1] is not None), key=lambda r: (r[3], r[2])):
        for i in sorted((i for i in invoices if i[1] == who and i[3] <= on), key=lambda i: (i[3], i[2])):
            part = min(rest, left[i[2]])
            if part > 0:
                want[id_, i[2]] = part
                left[i[2]], rest = left[i[2]] - part, rest - part
    write, names = allocation.written, []
    monkeypatch.setattr(allocation, "written", lambda df, name: names.append(name) or write(df, name))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    found = allocation.fifo(spark.createDataFrame(invoices, "direction string, party long, no long, date date, open_kr long"), spark.createDataFrame(receipts, "direction string, party long, id long, date date, open_kr long"))
    got = {(r.id, r.no): r.amount_kr for r in found.collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == want and names == ["sums"]


def test_no_step_over_the_journal_sorts_or_lists_it(spark):
    lines = spark.createDataFrame([(1, None, date(2026, 1, 1), "Taslak", "MAHSUP", 1, "600", 0, 0), (1, 2, date(2026, 1, 1), "Taslak", "MAHSUP", 1, "999", 0, 5), (2, 1, date(2026, 1, 1), "Taslak", "MAHSUP", 1, "999", 5, 0), (2, 2, date(2026, 1, 1), "Taslak", "MAHSUP", 1, "600", 5, 5)], "voucher long, line_no int, date date, status string, kind string, evidence long, account string, debit_kr long, credit_kr long")
    found = posting.validate(lines, spark.createDataFrame([("600",)], "code string"), "2026-01-01", "2026-12-31")
    assert {r.voucher: r.rule for r in found.collect()} == {1: "V3", 2: "V4"} and "SortAggregate" not in plan(found) and "BroadcastHashJoin" in plan(found)
    docs = spark.createDataFrame([(1, date(2026, 1, 1), 5), (2, date(2026, 1, 1), 0)], "no long, date date, net_kr long")
    posted = posting.posted(docs, "accrual", [("120", "net_kr", 0), ("600", 0, "net_kr")])
    assert sorted((r.doc_no, r.line_no, r.account) for r in posted.collect()) == [(1, 1, "120"), (1, 2, "600")] and "lambda" not in plan(posted)


def test_kinds_of_vouchers(spark):
    rnd = random.Random(3)
    rows = []
    for v in range(300):
        for i in range(rnd.randrange(1, 6)):
            side = rnd.random() < 0.5
            rows.append((v, i, rnd.choice(["120.7", "120.8", "600", "391.01", "153"]), 5 if side else 0, 0 if side else 5))
    rows += [(None, 1, "120", 5, 0), (None, 2, "600", 0, 5)]
    journal = spark.createDataFrame(rows, "voucher long, line_no int, account string, debit_kr long, credit_kr long").repartition(4)
    of = {}
    for v, _, a, d, _ in rows:
        of.setdefault(v, []).append((a.split(".")[0], d > 0))
    found = ledger.kinds(journal).collect()
    assert sum({r.voucher: r.vouchers for r in found}.values()) == len(of) and {(r.code, r.debit) for r in found if r.voucher == found[0].voucher} == set(of[found[0].voucher])
    want = {}
    for v, lines in of.items():
        for pair in {(a, b) for a, d in lines for b, e in lines if d != e and v is not None}:
            want[pair] = want.get(pair, 0) + 1
    rules = spark.createDataFrame([("120", "600"), ("600", "120"), ("153", "391")], "code string, contra string")
    got = {(r.code, r.contra): r.vouchers for r in audit.unexpected_contra(journal, rules).collect()}
    assert got == {k: n for k, n in want.items() if k[0] in ("120", "600", "153") and k not in {("120", "600"), ("600", "120"), ("153", "391")}}
    built = spark.createDataFrame([("a", 1, "B", "120"), ("a", 2, "A", "600"), ("b", 1, "B", "153")], "name string, line_no int, side string, code string")
    used = {r.name: r.usage for r in templates.template_list(built, built.limit(0), journal).collect()}
    shape = lambda *x: sum(set(lines) == set(x) for lines in of.values())
    assert used == {"a": shape(("120", True), ("600", False)), "b": shape(("153", True))}


def test_contras_of_equal_lines(spark):
    rows = [(1, 1, "100", 5, 0), (1, 1, "100", 5, 0), (1, 2, "101", 5, 0), (1, 3, "600", 0, 15), (1, 4, "101", 5, 0), (None, 1, "100", 5, 0)]
    journal = spark.createDataFrame(rows, "voucher long, line_no int, account string, debit_kr long, credit_kr long")
    got = {(r.voucher, r.side, r.chunk): r.contra for r in ledger.contras(journal).collect()}
    assert got == {(1, "credit", 0): "100, 101", (1, "debit", 0): "600"}
    assert plan(ledger.contras(journal)).count("Join") == 3


def test_texts_are_folded_once(spark):
    from tallyspark.operators import documents
    from tallyspark.plans import papers, valuation

    one = spark.createDataFrame([("iki yüz 5 üç",), ("",), (None,), ("12 34",), ("iki foo",), ("ikisi yalnız",)], "text string")
    found = documents.spelled(one)
    assert [r.number for r in found.collect()] == [203, None, None, None, None, 2]
    assert plan(found).count("regexp_extract_all") == 1 and plan(papers._spelled(spark, "/root/testdata/sf0.001")).count("regexp_extract_all") == 5
    assert plan(valuation._terms(spark, "/root/testdata/sf0.001")).count("split(") == 0
