"""Sources, sinks and streaming."""

from pyspark.sql import functions as F

from tallyspark.operators import documents, layout
from tallyspark.sources import io
from tallyspark.streaming import ingest


def test_chart_and_statement(spark, tmp_path):
    (tmp_path / "chart.csv").write_text("code,name\n100,Cash\n191,VAT, deductible\n8,Free\nx,Bad\n")
    assert {(r.code, r.name) for r in io.read_chart(spark, str(tmp_path / "chart.csv")).collect()} == {("100", "Cash"), ("191", "VAT, deductible")}
    rows = spark.createDataFrame([("01.02.2026", "a", "12.50"), ("2026-02-03", "b", "-3"), ("31.02.2026", "c", "1"), (None, None, None)], "date string, text string, amount string")
    good, bad = io.statement_rows(rows)
    assert {(str(r.date), r.amount_kr, r.direction) for r in good.collect()} == {("2026-02-01", 1250, "GIRIS"), ("2026-02-03", 300, "CIKIS")} and bad.count() == 2


def test_positioned_words(spark):
    xhtml = '<word xMin="10" yMin="0" xMax="20" yMax="10">A&amp;B</word><word xMin="40" yMin="1" xMax="50" yMax="11">12</word><word xMin="10" yMin="30" xMax="20" yMax="40">next</word>'
    words = documents.positioned(spark.createDataFrame([(1, 1, xhtml)], "doc_id long, page int, xhtml string"))
    assert [r.text for r in layout.lines(words).orderBy("line").collect()] == ["A&B   12", "next"]
    items = documents.line_items(spark.createDataFrame([(1, 1, "Pens 3 2.50 7.50"), (1, 2, "1 2 3")], "doc_id long, line int, text string")).collect()
    assert [(r.name, r.qty, r.price, r.amount) for r in items] == [("Pens", 3.0, 2.5, 7.5)]


def test_repeated_batches_append_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(10).select(F.col("id").alias("event_id")).write.parquet(src)
    for k in ("a", "b"):
        ingest.ingest(spark.readStream.schema("event_id long").parquet(src), out, str(tmp_path / k)).awaitTermination()
    assert spark.read.parquet(out).count() == 10
