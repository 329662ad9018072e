"""Lines, bands, columns and label values of positioned words."""

from pyspark.sql import functions as F

from tallyspark.operators import documents, layout

WORDS = "doc_id long, page int, k long, text string, x0 double, y0 double, x1 double, y1 double"


def placed(spark, rows, page=1):
    return spark.createDataFrame([(1, page, i, t, float(x), float(y), float(x + w), float(y + 10)) for i, (t, x, y, w) in enumerate(rows)], WORDS)


def texts(df):
    return [r.text for r in layout.lines(df).orderBy("doc_id", "page", "line").collect()]


PAGE = """<word xMin="60.0" yMin="70.0" xMax="140.0" yMax="88.0">FATURA</word><word xMin="60.0" yMin="110.0" xMax="92.0" yMax="120.0">Sayın</word>
<word xMin="60.0" yMin="126.0" xMax="130.0" yMax="136.0">EGE</word><word xMin="133.0" yMin="126.0" xMax="200.0" yMax="136.0">TEKSTİL</word>
<word xMin="60.0" yMin="160.0" xMax="100.0" yMax="170.0">Matrah</word><word xMin="420.0" yMin="160.0" xMax="480.0" yMax="170.0">8.000,00</word>"""
HEAD = [
    ("SAYIN:", 48, 130, 34), ("Ayşe", 86, 130, 32), ("YILMAZ", 122, 130, 30), ("İrsaliye", 330, 130, 38), ("Tarihi", 372, 130, 30), ("10.02.2006", 410, 130, 50),
    ("Örnek", 48, 145, 42), ("Caddesi", 94, 145, 38), ("İrsaliye", 330, 145, 38), ("Nu", 372, 145, 14), ("45678", 390, 145, 28),
]
ITEM = [("ÇORAP", 45, 220, 34), ("ADET", 165, 220, 26), ("200", 240, 220, 18), ("2,50", 305, 220, 22), ("8", 385, 220, 6), ("500,00", 470, 220, 34)]


def test_lines_and_labels(spark):
    words = documents.positioned(spark.createDataFrame([(1, 1, PAGE)], "doc_id long, page int, xhtml string"))
    assert texts(words) == ["FATURA", "Sayın", "EGE TEKSTİL", "Matrah   8.000,00"]
    got = {(r.label, r.value, r.relation, r.distance) for r in layout.label_values(layout.lines(words), ["matrah", "sayin"]).collect()}
    assert got == {("matrah", "8.000,00", "SAGINDA", 320.0), ("sayin", "EGE TEKSTİL", "ALTINDA", 16.0)}


def test_the_mean_moves_with_the_line(spark):
    # middles 5, 10, 13, 16: the third is within 6 of the mean 7.5, the fourth is not within 6 of 28 / 3
    assert texts(placed(spark, [("a", 0, 0, 5), ("b", 20, 5, 5), ("c", 40, 8, 5), ("d", 60, 11, 5)])) == ["a   b   c", "d"]
    assert texts(placed(spark, [("a", 0, 0, 5), ("b", 5.3, 0, 5), ("c", 11, 0, 5), ("d", 30, 0, 5)])) == ["ab c   d"]


def test_two_column_head_over_a_wide_table(spark):
    cells = {}
    for r in layout.grid(layout.lines(placed(spark, HEAD + ITEM))).orderBy("line", "cell").collect():
        cells.setdefault(r.line, []).append(r.text)
    assert cells == {1: ["SAYIN: Ayşe YILMAZ", "İrsaliye Tarihi 10.02.2006"], 2: ["Örnek Caddesi", "İrsaliye Nu 45678"], 3: ["ÇORAP", "ADET", "200", "2,50 8 500,00"]}  # the head fills 305 to 504
    found = layout.bands(layout.lines(placed(spark, HEAD + ITEM + [("Not", 40, 300, 20)])))
    assert [r.band for r in found.orderBy("line").collect()] == [0, 0, 0, 0]  # gaps 15, 75, 80: the usual one is 75
    two = layout.lines(placed(spark, [*HEAD, ("x", 40, 160, 9), *ITEM]))
    assert [r.band for r in layout.bands(two).orderBy("line").collect()] == [0, 0, 0, 1]
    assert [r.text for r in layout.grid(two).where("line = 4").orderBy("cell").collect()] == ["ÇORAP", "ADET", "200", "2,50", "8", "500,00"]


def test_columns_belong_to_their_page(spark):
    wide = placed(spark, [(f"w{i}", 45 + 60 * i, 130 + 15 * j, 59) for j in range(2) for i in range(8)], page=2)
    both = layout.grid(layout.lines(placed(spark, HEAD).unionByName(wide)))
    assert [r.text for r in both.where("page = 1 and line = 1").orderBy("cell").collect()] == ["SAYIN: Ayşe YILMAZ", "İrsaliye Tarihi 10.02.2006"]


def test_next_page_headings_and_marks(spark):
    first = spark.createDataFrame([(1, 1, 0, "Toplam", 60.0, 700.0, 95.0, 710.0), (1, 1, 1, ":", 97.0, 700.0, 99.0, 710.0), (1, 1, 2, "FATURA", 120.0, 694.0, 300.0, 716.0)], WORDS)
    second = spark.createDataFrame([(1, 3, 0, "12,00", 90.0, 20.0, 120.0, 30.0)], WORDS)
    got = layout.label_values(layout.lines(first.unionByName(second)), ["toplam"]).collect()
    assert [(r.place, r.value, r.relation, r.distance) for r in got] == [(1, "12,00", "ALTINDA", 680.0)]  # the heading is too high


def test_empty_null_and_repeated_words(spark):
    none = placed(spark, [("a", 0, 0, 5)]).where("false")
    assert layout.lines(none).count() == layout.grid(layout.lines(none)).count() == layout.label_values(layout.lines(none), ["a"]).count() == 0
    odd = spark.createDataFrame([(None, 1, 0, "Kdv", 0.0, 0.0, 20.0, 10.0), (1, 1, 0, None, 0.0, 0.0, 1.0, 1.0), (1, 1, 1, " ", 0.0, 0.0, 1.0, 1.0), (1, 1, 2, "x", None, 0.0, 1.0, 1.0), (1, 1, 3, "y", float("nan"), 0.0, 1.0, 1.0)], WORDS)
    assert [(r.doc_id, r.text) for r in layout.lines(odd).collect()] == [(None, "Kdv")]
    twice = placed(spark, [("Kdv", 0, 0, 20), ("8", 40, 0, 5), ("8", 40, 0, 5)])
    assert [(r.value, r.distance) for r in layout.label_values(layout.lines(twice), ["kdv"]).collect()] == [("8 8", 20.0)]
    assert layout.label_values(layout.lines(twice), []).count() == 0


def test_a_long_page_streams(spark):
    n = 60_000  # three words on each of 20,000 lines
    i = F.col("id")
    words = spark.range(n).select(F.lit(7).cast("long").alias("doc_id"), F.lit(1).alias("page"), i.alias("k"), F.lit("w").alias("text"), (i % 3 * 50).cast("double").alias("x0"), (F.floor(i / 3) * 20 + i % 3).cast("double").alias("y0"))
    words = words.withColumn("x1", F.col("x0") + 9).withColumn("y1", F.col("y0") + 10)
    seen = layout.lines(words).agg(F.count("*").alias("n"), F.max("line").alias("last"), F.min(F.size("words")).alias("least")).first()
    assert tuple(seen) == (20_000, 20_000, 3)


def test_words_are_shuffled_once_and_lines_span_batches(spark):
    words = [(1, 1, k, f"w{k}", 10.0 * k, 5.0 + 30.0 * (k // 3), 10.0 * k + 5, 15.0 + 30.0 * (k // 3)) for k in range(8)] + [(2, 1, 0, "x", 0.0, 0.0, 5.0, 10.0)]
    df = spark.createDataFrame(words, "doc_id long, page int, k long, text string, x0 double, y0 double, x1 double, y1 double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in (before, "1", "2", "4"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            out = layout.lines(df)
            got = sorted((r.doc_id, r.line, r.y, [w.text for w in r.words]) for r in out.collect())
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        assert got == [(1, 1, 10.0, ["w0", "w1", "w2"]), (1, 2, 40.0, ["w3", "w4", "w5"]), (1, 3, 70.0, ["w6", "w7"]), (2, 1, 0.0 + 5.0, ["x"])]
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
