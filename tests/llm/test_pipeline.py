"""Planted cases through the pipeline's stages."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_on_planted_rows(spark, tmp_path):
    rnd = random.Random(1)
    prose = lambda n: " ".join(rnd.choice("abcdefghij") + rnd.choice("klmnop") + str(rnd.randint(0, 99)) for _ in range(n))
    passage = prose(60)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("size(split(text, ' ')) > 30").orderBy("item_id").first().text
    clean = [(10_000 + i, prose(80) + "\n" + prose(20)) for i in range(20)]
    copy = prose(150)
    rows = [*clean, (1, prose(40) + "\n" + passage), (2, prose(40) + "\n" + passage), (3, copy), (4, copy + " end"), (5, prose(20) + " " + item), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    docs.write.parquet(str(tmp_path / "d"))
    kept = spark.read.parquet(str(tmp_path / "d"))
    after = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[1:4]):
        out = stage(spark, kept, SF)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        kept = spark.read.parquet(str(tmp_path / str(k)))
        after[name] = {r.doc_id: r.text for r in kept.collect()}
    assert sum(passage in (t or "") for t in after["line dedup"].values()) == 1 and {1, 2} <= set(after["line dedup"])
    assert len({3, 4} & set(after["n-gram Jaccard join"])) == 1
    last = after["benchmark decontamination"]
    assert 5 not in last and {i for i, _ in clean} <= set(last) and all(last[i] == t for i, t in clean)


def test_whole_pipeline(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0 and out.count() > 0
