"""Rules by literal cases, and window-like operators against loops."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import names
from tallyspark.operators import documents, posting, reconcile, running, tracing
from tallyspark.sources.model import view


def test_voucher_rules_in_order(spark):
    line = lambda v, n, a, d, c, day="2026-03-01", status="Taslak", kind="MAHSUP", evidence="x": (v, n, day, status, kind, evidence, a, d, c)
    rows = [
        *(line("final", n, "100", 0, 0, status="Kesin") for n in (1,)), line("V2", 1, "100", 5, 0),
        line("V3 both", 1, "100", 5, 5), line("V3 both", 2, "600", 0, 5), line("V3 none", 1, "100", 0, 0), line("V3 none", 2, "600", 0, 5),
        line("V3 negative", 1, "100", 5, -3), line("V3 negative", 2, "600", 0, 8), line("V3 first", 1, "999", 0, 0), line("V3 first", 2, "600", 0, 5),
        line("V4", 1, "999", 5, 0), line("V4", 2, "600", 0, 0), line("V6", 1, "100", 5, 0, "2025-12-31"), line("V6", 2, "600", 0, 4, "2025-12-31"),
        line("V1", 1, "100", 5, 0, kind="TAHSIL", evidence=None), line("V1", 2, "600", 0, 4, kind="TAHSIL", evidence=None),
        line("V7", 1, "100", 5, 0, kind="TEDIYE", evidence=None), line("V7", 2, "600", 0, 5, kind="TEDIYE", evidence=None),
        line("OK", 1, "100", 5, 0, evidence=None), line("OK", 2, "600", 0, 5, evidence=None), line("OK last day", 1, "100", 5, 0, "2026-12-31"), line("OK last day", 2, "600", 0, 5, "2026-12-31"),
    ]
    df = spark.createDataFrame(rows, "voucher string, line_no int, date string, status string, kind string, evidence string, account string, debit_kr long, credit_kr long").withColumn("date", F.col("date").cast("date"))
    chart = spark.createDataFrame([("100",), ("600",)], "code string")
    got = {r.voucher: r.rule for r in posting.validate(df, chart, "2026-01-01", "2026-12-31").collect()}
    assert got == {v: {"final": "FINAL"}.get(v, v.split()[0]) for v in {r[0] for r in rows}}
    closed = {r.voucher: r.rule for r in posting.validate(df, chart, "2026-01-01", "2026-12-31", period_open=False).collect()}
    assert closed["V6"] == closed["V1"] == closed["OK"] == "V5" and closed["V4"] == "V4"


@pytest.mark.parametrize(
    "raw, name",
    [
        ("SAYIN Ali VELİ - FAST Anlık Ödeme", "ALI VELI"), ("Ali Veli-EFT 123", "ALI VELI"), ("Ali Veli — Gönderilen havale", "ALI VELI"), ("Ali Veli – ödemeler", "ALI VELI"), ("Ali - FAST", "ALI - FAST".replace(" - ", " ")),
        ("Ali Veli - şube", "ALI VELI SUBE"), ("Prof. Dr. Ayşe Gül", "AYSE GUL"), ("Ak-Ka Gıda", "AK-KA GIDA"), ("A.B. Ticaret, Ltd.", "A B TICARET LTD"), ("Ali", "ALI"), ("", ""),
    ],
)
def test_canonical_names(spark, raw, name):
    assert spark.createDataFrame([(raw,)], "n string").select(names.canonical("n")).first()[0] == name


def test_running_over_a_hot_key(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["hot"] * 8 + ["a", "b", None]), i, rnd.choice([None, *range(-9, 10)])) for i in range(800)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else ranges as small as these become one
    try:
        parts = running.ranged(df, ["k"], ["i"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts.where("k = 'hot'").select(running.PART).distinct().count() > 1
    out = running.running(parts, ["k"], ["i"], {"s": (F.sum, F.col("v")), "m": (F.min, F.col("v")), "last": (F.max, F.struct("i", "v"), -1)}).collect()
    assert len(out) == len(rows)
    by = {}
    for r in sorted(out, key=lambda r: r.i):
        seen = by.setdefault(r.k, [])
        assert (r["last"] or (None, None)) == (seen[-1] if seen else (None, None))
        seen.append((r.i, r.v))
        known = [v for _, v in seen if v is not None]
        assert (r.s, r.m) == ((sum(known), min(known)) if known else (None, None))


def test_instalments_against_a_loop(spark):
    rnd = random.Random(2)
    day = lambda: date(2026, 1, 1) + timedelta(rnd.randint(0, 40))
    items = [(n, p, "GIRIS", rnd.choice([100, 200]), rnd.choice("AB"), d, d + timedelta(30 * p)) for n in range(60) for d in (day(),) for p in (1, 2)]
    moves = [(r, "GIRIS", rnd.choice([100, 200]), rnd.choice("AB"), day()) for r in range(90)]
    used, want = set(), {}
    for n, p, way, amount, name, d, due in sorted(items, key=lambda i: (i[5], i[0], i[1])):
        ref = next((r for r, w, a, x, e in sorted(moves, key=lambda m: (m[4], m[0])) if (w, a, x) == (way, amount, name) and e >= d and r not in used), None)
        used.add(ref)
        want[n, p] = ref, "TAHSIL" if ref is not None else "GECIKMIS" if due < date(2026, 2, 15) else "BEKLIYOR"
    i = spark.createDataFrame(items, "no long, part int, direction string, amount_kr long, name string, date date, due date")
    m = spark.createDataFrame(moves, "ref long, direction string, amount_kr long, name string, date date")
    out = tracing.instalments(i, m, "2026-02-15")
    assert {(r.no, r.part): (r.ref, r.status) for r in out.collect()} == want and len(set(dict(want.values()))) > 20
    assert {r.ref for r in tracing.unmatched(m, out).collect()} == set(range(90)) - used


def test_nearest_counterparts_by_islands_against_a_loop(spark):
    rnd = random.Random(3)
    day = lambda: date(2026, 1, 1) + timedelta(rnd.choice([0, 100, 200]) + rnd.randint(0, 20))
    ours = [(n, rnd.choice("AB"), rnd.choice([1, 2]), day()) for n in range(70)]
    theirs = [(1000 + n, rnd.choice("AB"), rnd.choice([1, 2]), day()) for n in range(60)]
    number = lambda d: d.year * 372 + d.month * 31 + d.day
    left, want = list(theirs), set()
    for n, name, amount, d in sorted(ours, key=lambda o: (number(o[3]), o[0])):
        near = min(((abs(number(e) - number(d)), t) for t, x, a, e in left if (x, a) == (name, amount)), default=None)
        if near and near[0] <= 5:
            want.add((n, near[1]))
            left = [t for t in left if t[0] != near[1]]
    s = "id long, name string, amount_kr long, date date"
    got = reconcile.reconcile(spark.createDataFrame(ours, s), spark.createDataFrame(theirs, s), 5)
    assert {(r.id, r.their_id) for r in got.collect()} == want and len(want) > 20


def test_documents_are_resolved(spark):
    schema = "doc_id int, language string, kind string, date date, party string, net_kr long, vat_kr long, rate long, total_kr long, words_kr long, items_kr long, n_items int, n_read int, needs_party boolean"
    good = ["tr", "fatura", date(2026, 1, 2), "Ali", 10_000, 2_000, 20, 12_034, 12_000, 10_000, 2, 2, True]
    change = lambda **x: [x.get(k, v) for k, v in zip([c.split()[0] for c in schema.split(", ")][1:], good)]
    rows = [change(total_kr=12_000), change(total_kr=12_000, words_kr=13_000), change(total_kr=12_000, language=""), change(total_kr=12_000, date=None), change(total_kr=12_000, items_kr=9_999), change(total_kr=12_000, vat_kr=2_101), change(total_kr=None), change()]
    got = {r.doc_id: (r.findings, r.confidence, r.ready) for r in documents.resolve(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)).collect()}
    assert got[0] == ("B00,B00", 100, True) and got[1] == ("B03,B00", 50, False) and got[2] == ("B01,B00,B00", 65, False) and got[3] == ("B00,B00,B07", 65, False)
    assert got[4] == ("B00,B04", 85, True) and got[5] == ("B00,B00,B05,B06", 80, True) and got[6] == ("B07", 0, False) and got[7] == ("B00,B00,B05", 90, True)


def test_provenance_of_an_invoice(spark):
    inv = spark.createDataFrame([(1, 100), (2, 50), (3, 10), (4, 0)], "no long, net_debt_kr long")
    rec = spark.createDataFrame([(7, "B", 90), (8, None, 60)], "id long, bank string, amount_kr long")
    a = spark.createDataFrame([(7, 1, 90), (8, 1, 10), (8, 2, 40)], "id long, no long, amount_kr long")
    v = spark.createDataFrame([(70, "accrual", 1, 100), (71, "receipt", 7, 90), (72, "cost", 9, 5)], "voucher long, kind string, doc_no long, amount_kr long")
    assert {(r.source, r.target, r.kind) for r in tracing.provenance(inv, rec, a, v).collect()} == {
        ("invoice:1", "voucher:70", "accrual"), ("receipt:7", "invoice:1", "allocation"), ("receipt:8", "invoice:1", "allocation"), ("receipt:8", "invoice:2", "allocation"), ("receipt:7", "voucher:71", "receipt"), ("bank:B", "receipt:7", "bank"),
    }
    assert {r.no: (r.level, r.confidence) for r in tracing.provenance_confidence(inv, a).collect()} == {1: ("TAM", 100), 2: ("KISMI", 60), 3: ("ESLESMEYEN", 30), 4: ("TAM", 100)}


def test_views_follow_their_input(spark, tmp_path):
    write = lambda n: spark.range(n).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "x.parquet"))
    make = lambda s, d: s.read.parquet(f"{d}/x.parquet")
    write(3)
    assert view(spark, str(tmp_path), "x", make).count() == 3
    write(300)
    assert view(spark, str(tmp_path), "x", make).count() == 300


def test_labels_and_languages_of_documents(spark):
    from tallyspark.operators import documents

    schema = "doc_id long, language string, kind string, date string, party string, net_kr long, vat_kr long, rate int, total_kr long, words_kr long, items_kr long, n_items int, n_read int, needs_party boolean, label_states array<string>"
    slip = (1, "ru", "makbuz", "2026-02-10", None, None, None, None, 10_217_736, 10_217_700, None, 0, 0, False, None)
    rows = [slip, (2, *slip[1:-1], ["TAM", None, "ONERI", "BELIRSIZ"]), (3, None, *slip[2:-1], []), (4, "en", *slip[2:])]
    got = documents.resolve(spark.createDataFrame(rows, schema)).collect()
    # 10 language, 10 kind, 15 total, 10 date, 25 words
    assert {r.doc_id: (r.findings, r.confidence, r.ready) for r in got} == {1: ("B09,B00", 70, True), 2: ("B09,B00,B10,B11", 50, False), 3: ("B01,B00", 20, False), 4: ("B00", 70, True)}
