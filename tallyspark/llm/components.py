"""Connected components by alternating stars, as joins and aggregations over the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.work import dropped, staged


def components(edges: DataFrame) -> DataFrame:
    """`edges` (a, b: longs) to (node, root), root being the least node that can be reached; only nodes with edges appear.

    The number of rounds grows with the logarithm of a component's size.  Each round is written, so that a lost executor
    costs one round, and deleted after the next; hubs are joined with their minimum by skew joins and never gathered.
    """
    e = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = staged(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        met = large.join(least, "a")
        before, e = e, staged(met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        dropped(before, large)
        if now == state:
            break
        state = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
