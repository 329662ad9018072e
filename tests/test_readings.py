"""Texts read in arrays, against `candidates` on their lines; what is shuffled and written."""

import random
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.functions.arrays import only
from tallyspark.operators import candidates, readings
from tallyspark.operators.candidates import AMOUNT, DATE, TAX_ID, TEXT, Equation, Field
from tallyspark.plans import reading
from tallyspark.sources import model

SF = "/root/testdata/sf0.001"
FIELDS = [
    Field("net", AMOUNT, ("net", "net tutar", "tutar net")), Field("kdv", AMOUNT, ("kdv", "hesaplanan kdv")), Field("toplam", AMOUNT, ("toplam", "genel toplam", "1")), Field("eksik", AMOUNT, ("eksik",)),
    Field("tarih", DATE, ("tarih", "fatura tarihi")), Field("vkn", TAX_ID, ("vkn", "vergi no")), Field("unvan", TEXT, ("sayin", "a b")),
]
RULES = {
    "none": [], "sum": [Equation("s", (("net", 1), ("kdv", 1)), "toplam")], "unknown": [Equation("u", (("net", 1), ("nothing", 1)), "toplam")],
    "several": [Equation("s", (("net", 1), ("kdv", 1)), "toplam"), Equation("d", (("toplam", 1), ("net", -1)), "kdv", absolute=True), Equation("one", (("net", 1),), "toplam"), Equation("four", (("net", 1), ("kdv", 1), ("eksik", -1), ("tarih", 1)), "toplam")],
}


def rows_of(df):
    cols = sorted(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def texts():
    """Pages of labels and values that meet in odd ways: small amounts, so that equations hold often, and marks, rates, accents, blanks and lines without cells."""
    rnd = random.Random(4)
    labels = ["Net", "NET TUTAR:", "Tutar Net .-", "KDV %8", "KDV % 20 :", "Hesaplanan KDV", "Toplam", "GENEL TOPLAM:", "Genel  Toplam", "Eksik", "Fatura Tarihi", "TARİH:", "VKN:", "Vergi No", "SAYIN", "Sayın:", "A B", "x", ":", "Yalnız", "Ş"]
    values = ["1,00", "2,00", "3.00", "1", "4", "-2,00", "1.234,56", "1,234.56", "8%8 2,00", "% 5 3", "5.,%", "12.04.2026", "31.02.2026", "1-1-2026 01/01/2026", "29.02.2100", "1234567890", "x12345678901y123", "123456789012", "Ayşe", " ", ".", ",50", "9" * 25, "0,05", "1 2 3 4 5 6 7 8", "TL 2,00-", "\t3,00\r", "ıİß"]
    pages = []
    for doc in range(400):
        lines = []
        for _ in range(rnd.choice([0, 1, 4, 9, 9])):
            cells = [rnd.choice(labels) + rnd.choice(["", " ", ": "]) + rnd.choice(["", *values]) if rnd.random() < 0.6 else rnd.choice(values) for _ in range(rnd.choice([0, 1, 1, 2, 3]))]
            lines.append(rnd.choice(["   ", "    ", "      "]).join(cells))
        pages.append((doc, rnd.choice(["\n", "\n", "\r\n"]).join(lines)))
    for doc in range(400, 460):  # equations that hold
        net, kdv = rnd.randrange(1, 6), rnd.randrange(1, 4)
        pages.append((doc, f"Net   {net},00 {rnd.randrange(9)},00\nKDV %8   {kdv},00\nToplam: {net + kdv + rnd.choice([0, 0, 0, 1])},0{rnd.randrange(3)}   {net + kdv},00\nEksik 1\nTarih 01.01.2026   Sayın   Ali"))
    return [*pages, (None, "Net 1"), (1000, None), (1001, "")]


@pytest.fixture(scope="module")
def found(spark, texts):
    df = spark.createDataFrame([t for t in texts if t[0] is not None], "doc_id long, text string").repartition(3)
    return df, candidates.candidates(candidates.lines_of(df), FIELDS).localCheckpoint()


def test_candidates(found):
    df, want = found
    got = readings.field_candidates(df, FIELDS)
    assert got.dtypes == want.dtypes and rows_of(got) == rows_of(want) and want.count() > 1500
    assert {r.strategy for r in want.collect()} == set(readings.WAYS)
    assert readings.field_candidates(df.limit(0), FIELDS).count() == 0 and readings.field_candidates(df, []).count() == 0


@pytest.mark.parametrize("name", list(RULES))
def test_chosen_and_filled(found, name):
    df, seen = found
    want = candidates.filled(seen, RULES[name], ",")
    got = readings.filled(df, FIELDS, RULES[name], ",")
    assert got.dtypes == want.dtypes and rows_of(got) == rows_of(want)
    assert name != "sum" or want.where("filled").count() > 50
    if RULES[name]:
        assert rows_of(readings.chosen(df, FIELDS, RULES[name], ",")) == rows_of(candidates.chosen(seen, RULES[name], ","))
    assert readings.filled(df.limit(0), FIELDS, RULES[name], ",").count() == 0


def test_texts_are_read_some_at_a_time(spark, texts, monkeypatch):
    df = spark.createDataFrame(texts, "doc_id long, text string")
    schema = pa.schema([("doc_id", pa.int64()), ("field", pa.string()), ("value", pa.string()), ("number", pa.int64()), ("candidates", pa.int64()), ("filled", pa.bool_()), ("approved", pa.bool_())])
    read = partial(readings._filled, FIELDS, RULES["sum"], ",")
    made = []
    for size in (1, 300, 1 << 22):
        monkeypatch.setattr(readings, "TOGETHER", size)
        made.append(pa.Table.from_batches(readings._batches(read, schema, iter(df.toArrow().combine_chunks().to_batches(100))), schema).to_pylist())
    assert made[0] == made[1] == made[2] and any(r["filled"] for r in made[0])


def test_numbers(spark):
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("0123456789.,- x") for _ in range(rnd.randrange(0, 14))) for _ in range(3000)] + [None, "", "-", "9" * 18, "9" * 19, "0" * 30 + "7", "92233720368547758,07", "92233720368547758,08", "٣4"]
    days = [f"{rnd.randrange(0, 34):02}.{rnd.randrange(0, 14):02}.{rnd.choice([1899, 1900, 2000, 2023, 2024, 2100, 2200, 2201, 0])}" for _ in range(2000)]
    for kind, marks, xs in ((AMOUNT, ",.", texts), (DATE, ",", [*texts, *days]), (TAX_ID, ",", texts), (TEXT, ",", texts)):
        for mark in marks:
            df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string").select("i", candidates.typed(F.lit(kind), F.col("x"), mark).alias("n"))
            want = [r.n for r in df.orderBy("i").collect()]
            number, known = readings._numbers(kind, pa.array(xs, pa.string()), mark)
            assert [n if k else None for n, k in zip(number.tolist(), np.broadcast_to(known, len(xs)).tolist())] == want
    assert only(pa.array(["xx", "ş1a", None, "", "a2"])[1:], "12a").to_pylist() == ["1a", None, "", "a2"]


@pytest.mark.parametrize("name", ["field_candidates", "candidate_selection", "auto_fill"])
def test_only_amounts_are_shuffled(spark, monkeypatch, name):
    """Candidates were written and shuffled a dozen times."""
    monkeypatch.setattr(model, "written", lambda *_: pytest.fail("a table is written"))
    plan = reading.QUERIES[name][0](spark, SF)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") <= 2


def test_parts_that_are_there_twice(spark, tmp_path):
    for t in ("orders", "lineitem", "part"):
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        (df.union(df.limit(20)) if t == "part" else df).write.parquet(str(tmp_path / f"{t}.parquet"))
    columns = ["no", "party", "date", "net_kr", "vat_kr", "gross_kr"]
    for d in (str(tmp_path), SF):
        assert rows_of(model.sale_amounts(spark, d)) == rows_of(model.sales(spark, d).select(*columns))
