"""Running sums and the like within keys of any size.

Rows are divided into ranges of (key, order) and written with the number of their range.  A window then needs the rows of
one range only; what it lacks is one value for each range and key, from the ranges before it.  A key's first range lacks
nothing, so that a range has one key at most that it must be given a value for: that table has a row for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.sources.scratch import written

PART = "_part"


def ranged(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`rows`, written in ranges of `keys` and `order`, with the number of the range."""
    return written(rows.repartitionByRange(*keys, *order).withColumn(PART, F.spark_partition_id()), "ranges")


def running(parts: DataFrame, keys: list[str], order: list[str], columns: dict[str, tuple]) -> DataFrame:
    """`parts` (of `ranged`) with `columns`: name to (aggregate, value), over each key's rows up to and with the own one, or
    (aggregate, value, -1), without the own one.

    The aggregate is one that can be taken of its own results: sum, min, max.  Rows of a key are told apart by `order`.
    """
    names = list(columns)
    here = parts.groupBy(PART, *keys).agg(*[how(value).alias(n) for n, (how, value, *_) in columns.items()])
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = here.select(PART, *keys, F.count("*").over(before).alias("_ranges"), *[how(F.col(n)).over(before).alias(f"_{n}") for n, (how, *_) in columns.items()])
    carried = carried.where("_ranges > 0").drop("_ranges")  # a row for each range at most, so it may be sent to every task
    own = Window.partitionBy(PART, *keys).orderBy(*order)
    out = parts.select("*", *[how(value).over(own.rowsBetween(Window.unboundedPreceding, back[0] if back else 0)).alias(n) for n, (how, value, *back) in columns.items()])
    for k in keys:
        carried = carried.withColumnRenamed(k, f"_k_{k}")
    on = out[PART] == carried[PART]
    for k in keys:
        on = on & out[k].eqNullSafe(carried[f"_k_{k}"])
    met = out.join(F.broadcast(carried), on, "left").select(out["*"], *[carried[f"_{n}"] for n in names])
    for n, (how, *_) in columns.items():
        met = met.withColumn(n, _both(how, F.col(n), F.col(f"_{n}"))).drop(f"_{n}")
    return met


def _both(how, a: Column, b: Column) -> Column:
    if how is F.sum:
        return F.when(a.isNull(), b).otherwise(a + F.coalesce(b, F.lit(0)))
    return (F.least if how is F.min else F.greatest)(a, b)
