"""Operators that follow an order, with a third of all rows or more under one key, against loops; literal cases of the books."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import allocation, audit, desk, lifecycle, reconcile


@pytest.fixture
def small_ranges(spark):
    """Ranges as small as these stay apart."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_lifecycle_of_a_hot_invoice(spark, small_ranges):
    rnd = random.Random(2)
    toggle = lifecycle.Machine(("A", "B", "C"), {"x": {"A": "B", "B": "C"}, "y": {"C": "A", "B": "A"}, "z": {"A": "C"}})
    for machine, events in ((lifecycle.INVOICE, ["olustur", "gonder", "kesinlesti", "sil", None]), (toggle, ["x", "y", "z", "?"])):
        rows = [(rnd.choice([1, 1, rnd.randrange(40)]), datetime(2026, 1, 1) + timedelta(hours=rnd.randrange(200)), i, rnd.choice(events)) for i in range(1500)]
        want, state = [], {}
        for no, at, i, event in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
            old = state.get(no, machine.states[0])
            new = machine.moves.get(event, {}).get(old, old)
            state[no] = new
            want.append((no, i, old, new, old != new))
        df = spark.createDataFrame(rows, "no long, at timestamp, id long, event string").repartition(4)
        got = lifecycle.lifecycle(df, machine).select("no", "id", "before", "after", "accepted").collect()
        assert sorted(map(tuple, got)) == sorted(want)
        assert lifecycle.lifecycle(df.limit(0), machine).count() == 0


def test_invoice_rules(spark):
    t = lambda h: datetime(2026, 3, 1, h)
    rows = [(1, t(1), 1, "olustur"), (1, t(2), 2, "olustur"), (1, t(3), 3, "kesinlesti"), (1, t(4), 4, "gonder"), (1, t(5), 5, "gonder"), (1, t(6), 6, "kesinlesti"), (2, t(1), 7, "gonder"), (3, t(1), 8, "olustur")]
    walked = lifecycle.lifecycle(spark.createDataFrame(rows, "no long, at timestamp, id long, event string"))
    assert [r.id for r in walked.where("not accepted").orderBy("id").collect()] == [2, 3, 5, 7]
    got = {r.no: (r.state, r.uuid, r.archive, r.voucher_date, r.refused) for r in lifecycle.invoices(walked).collect()}
    assert got == {1: ("KESINLESTI", "EF-1-000004", "arsiv/1.xml", date(2026, 3, 1), 3), 3: ("TASLAK", None, None, None, 0)}


@pytest.mark.parametrize("window", [0, 4, 40, None])
def test_nearest_counterparts_of_a_hot_group(spark, small_ranges, window):
    rnd = random.Random(7)
    day = lambda: date(2026, 1, 1) + timedelta(rnd.randrange(120))
    group = lambda: ("hot", 500) if rnd.random() < 0.6 else (rnd.choice(["a", "b", None]), rnd.choice([1, 2]))
    ours = [(n, *group(), day()) for n in range(500)]
    theirs = [(1000 + n * 7919 % 503, *group(), day()) for n in range(450)]
    number = lambda d: d.year * 372 + d.month * 31 + d.day
    left, want = list(theirs), set()
    for n, name, amount, d in sorted(ours, key=lambda o: (number(o[3]), o[0])):
        near = min(((abs(number(e) - number(d)), t) for t, x, a, e in left if (x, a) == (name, amount)), default=None)
        if near and (window is None or near[0] <= window):
            want.add((n, near[1]))
            left = [t for t in left if t[0] != near[1]]
    s = "id long, name string, amount_kr long, date date"
    ours_df, theirs_df = spark.createDataFrame(ours, s), spark.createDataFrame(theirs, s)
    got = reconcile.reconcile(ours_df, theirs_df, window)
    assert {(r.id, r.their_id) for r in got.collect()} == want and got.count() == len(want) > 100
    rest = reconcile.leftovers(ours_df, got, theirs_df).collect()
    assert {r.id for r in rest} == {o[0] for o in ours} - {a for a, _ in want}


def test_reversals_need_a_hint_an_original_and_a_name(spark):
    rows = [  # account, seq, direction, amount, text, name
        (1, 1, "GIRIS", 100, "havale", "Ali Veli"), (1, 2, "CIKIS", 100, "İADE", "ALİ VELİ - FAST ödeme"), (1, 3, "CIKIS", 100, "iade", "Mehmet Demir"), (1, 4, "CIKIS", 100, "kira", "Ali Veli"), (1, 5, "CIKIS", 101, "iade", "Ali Veli"),
        (1, 6, "GIRIS", 100, "iade", "Ali Can"), (1, 7, "CIKIS", 50, "refund", None), (1, 8, "GIRIS", 50, "Refund", None), (1, 9, "CIKIS", 50, "refund", "Ali Veli"), (2, 10, "CIKIS", 100, "ters:", "Ali Veli"), (1, 11, "GIRIS", 100, "chargeback", "Ali Veli Kaya"), (1, 12, "GIRIS", 50, None, None),
    ]
    df = spark.createDataFrame(rows, "account long, seq long, direction string, amount_kr long, text string, name string")
    assert {(r.seq, r.reverses) for r in reconcile.reversals(df).collect()} == {(2, 1), (8, 7), (11, 4)}
    assert reconcile.reversals(df.limit(0)).count() == 0


def test_gaps_of_a_hot_series(spark, small_ranges):
    rnd = random.Random(4)
    numbers = sorted(rnd.sample(range(2000), 900))
    rows = [("hot", n, date(2026, 1, 1) + timedelta(n // 9 + rnd.choice([0, 0, -30]))) for n in numbers] + [("b", 1, date(2026, 1, 1)), ("b", 3, date(2026, 1, 2))]
    want = {("b", 3, 1, False)}
    for (_, a, d), (_, b, e) in zip(rows, rows[1:900]):
        if b - a != 1 or e < d:
            want.add(("hot", b, a, e < d))
    got = audit.sequence_gaps(spark.createDataFrame(rows, "series string, number long, date date")).collect()
    assert {tuple(r) for r in got} == want


def test_accounts_of_instruments(spark):
    """Sales: 102, 100, 101, 121 against 120; purchases: 320 against 102, 100, 103, 321; anything else is the bank's."""
    kinds = ["BANKA", "NAKIT", "CEK", "SENET", "ACIK"]
    money = spark.createDataFrame([(i, k) for i, k in enumerate(kinds)], "id long, instrument string")
    alloc = spark.createDataFrame([(i, 10 if i else 11, 5 + i) for i in range(5)], "id long, no long, amount_kr long")
    for way, own, party in (("SATIS", ["102", "100", "101", "121", "102"], "120"), ("ALIS", ["102", "100", "103", "321", "102"], "320")):
        lines = desk.allocation_lines(alloc, money, way).orderBy("id", "line_no").collect()
        pairs = [(lines[2 * i], lines[2 * i + 1]) for i in range(5)]
        assert [(a.account, b.account) for a, b in pairs] == [(x, party) if way == "SATIS" else (party, x) for x in own]
        assert all(a.debit_kr == b.credit_kr == 5 + i and a.credit_kr == b.debit_kr == 0 for i, (a, b) in enumerate(pairs))
        legs = allocation.payment_legs(alloc, money, way).collect()
        assert sum(r.debit_kr for r in legs) == sum(r.credit_kr for r in legs) == 35 and {r.instrument for r in legs} == {"BANKA", "KARMA"}
        assert {(r.no, r.account) for r in legs} == {(11, "102"), (11, party), (10, "100"), (10, own[2]), (10, own[3]), (10, "102"), (10, party)}


def test_reminders_transfers_and_cards(spark):
    open_ = spark.createDataFrame([(1, "B", 10, 9), (2, "B", 5, 8), (3, "B", 1, 7), (4, "C", 2, 99)], "id long, bank string, remaining_kr long, age_days int")
    got = {r.bank: (r.n, r.open_kr, r.awaited, r.reminders) for r in desk.waiting(open_, spark.createDataFrame([(1,), (3,), (3,)], "id long")).collect()}
    assert got == {"B": (3, 16, 2, 1), "C": (1, 2, 0, 0)}
    money = spark.createDataFrame([("SATIS", "NAKIT", date(2026, 1, 5), 7), ("ALIS", "NAKIT", date(2026, 1, 9), 3), ("ALIS", "NAKIT", date(2026, 1, 30), 4), ("ALIS", "BANKA", date(2026, 1, 9), 9)], "direction string, instrument string, date date, amount_kr long")
    assert [tuple(r) for r in audit.cash_transfers(money).collect()] == [(date(2026, 1, 1), 2, 7)] and audit.cash_transfers(money.where("direction = 'SATIS'")).count() == 0
    assets = spark.createDataFrame([(1, "253.01", 5), (2, "253.01", 6), (3, "252", 7), (4, "253.012", 8)], "id long, code string, value_kr long")
    journal = spark.createDataFrame([("253.01", 20, 3), ("253.01.5", 1, 0), ("252", 4, 0)], "account string, debit_kr long, credit_kr long")
    cards = lambda p: sorted((r.id, r.booked_kr) for r in desk.asset_cards(assets, journal, p).collect())
    assert cards("253.01") == [(1, 17), (2, 17)] and cards("25") == [(1, 17), (2, 17), (3, 4), (4, 0)] and cards("*") == cards("25")
