"""Short documents read whole in one task, against `layout` on the same words; what is shuffled and written."""

import random
from functools import partial

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.functions.names import plain, simplify
from tallyspark.operators import layout, sheets
from tallyspark.plans import papers
from tallyspark.sources import model

SF = "/root/testdata/sf0.001"
WORDS = "array<struct<page: int, k: long, text: string, x0: double, y0: double, x1: double, y1: double>>"
LABELS = ["kdv", "toplam kdv", "a"]
WAYS = {
    "lines": (sheets.lines, lambda w: layout.lines(w).drop("words"), sheets._lines),
    "grid": (sheets.grid, lambda w: layout.grid(layout.lines(w)), sheets._grid),
    "labels": (lambda r, w: sheets.label_values(r, w, LABELS), lambda w: layout.label_values(layout.lines(w), LABELS), partial(sheets._label_values, LABELS)),
}


def rows_of(df):
    cols = sorted(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def pages():
    """Documents of several rows and pages, with drifting words, equal words, marks, headings, blanks, and words of which something is missing."""
    rnd = random.Random(8)
    rows = []
    for doc in [*range(60), None]:
        k = 0
        for _ in range(rnd.choice([1, 1, 2, 5, 20])):
            words = []
            for _ in range(rnd.randrange(0, 6)):
                x, y, high = rnd.randrange(0, 40) * 7.25, rnd.randrange(0, 12) * 9 + rnd.choice([0, 0, 1.5, 3]), rnd.choice([10, 10, 10, 8, 26])
                word = (rnd.choice([1, 1, 2, 5]), k, rnd.choice(["KDV", "Toplam", "a", ":", "İğne", "12,00", "x y", " ", None, "ßa"]), x, float(y), x + rnd.choice([5, 20, 60, -3]), float(y + high))
                if rnd.random() < 0.05:
                    word = (*word[:3], None if rnd.random() < 0.5 else float("nan"), *word[4:])
                words += [word] * rnd.choice([1, 1, 1, 1, 2])
                k += 1
            rows.append((doc, words))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("name", list(WAYS))
@pytest.mark.parametrize("long", [0, 3, 20_000])
def test_as_layout_reads_them(spark, pages, monkeypatch, name, long):
    monkeypatch.setattr(sheets, "LONG", long)
    df = spark.createDataFrame(pages, f"doc_id long, words {WORDS}").repartition(3)
    made, other, _ = WAYS[name]
    want = rows_of(other(df.select("doc_id", F.inline("words"))))
    found = made(df, F.col("words"))
    assert rows_of(found) == want and len(want) > 50
    assert found.dtypes == other(df.select("doc_id", F.inline("words"))).dtypes
    assert made(df.limit(0), F.col("words")).count() == 0


@pytest.mark.parametrize("name", list(WAYS))
@pytest.mark.parametrize("batch, together, few", [(1, 1, 1), (7, 20, 1), (1000, 1 << 17, 10**9)])
def test_documents_span_batches(spark, pages, monkeypatch, name, batch, together, few):
    monkeypatch.setattr(sheets, "TOGETHER", together)
    monkeypatch.setattr(sheets, "FEW", few)
    df = spark.createDataFrame(pages, f"doc_id long, words {WORDS}").where("doc_id is not null")
    want = WAYS[name][1](df.select("doc_id", F.inline("words")))
    t = df.coalesce(1).sortWithinPartitions("doc_id").toArrow()
    schema = pa.schema([pa.field(c, sheets._ARROW[kind]) for c, kind in want.dtypes])
    read = [b for b in sheets._reader(WAYS[name][2], schema, iter(t.combine_chunks().to_batches(batch)))]
    got = pa.Table.from_batches(read, schema).to_pylist()
    assert sorted((tuple(r[c] for c in sorted(r)) for r in got), key=repr) == rows_of(want)


def test_plain_is_simplify(spark):
    chars = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = [*chars, "", None, "  KDV % 8 ", "ΑΣ Σ", "İİ ÇĞ-x", "a\nb"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", simplify("t").alias("t"))
    want = [r.t for r in df.orderBy("i").collect()]
    assert plain(pa.array(texts, pa.string())).to_pylist() == want and plain(pa.array(["A b", ""])).to_pylist() == ["a b", ""]


@pytest.mark.parametrize("name", ["layout_lines", "layout_grid", "label_values"])
def test_only_the_rows_of_a_page_are_shuffled(spark, monkeypatch, name):
    """Words were shuffled, and their lines written and shuffled again."""
    monkeypatch.setattr(model, "written", lambda *_: pytest.fail("a table is written"))
    plan = papers.QUERIES[name][0](spark, SF)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    whole = plan[: plan.index("_fold")]
    assert "words" not in whole[whole.index("Exchange hashpartitioning") :].split("FileScan")[0] and whole.split("+- Project [doc_id")[1].count("Exchange") <= 1
