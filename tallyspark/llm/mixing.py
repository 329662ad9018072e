"""Mixing sources to target weights by pivotal dependent rounding.

A source that is to give `target` of its `source_size` words has each of its documents floor(r) times, r being target over
source_size, and once more with probability r - floor(r).  Pivotal rounding settles these fractions together: two documents
exchange mass, in words, until one of them is whole: has its extra copy, or has not.  Which of the two gives is drawn so that
each keeps its expected mass.  Words are conserved, so that a source misses its target by its last document only.

1. Units are rows of one source, key and size, counted; of k equal ones floor(k * fraction) get the copy at once, and one
   carries the rest.  A key may hold any share of all rows.
2. The units of a source are dealt into blocks of about `BLOCK` by a hash of their keys.  A block is swept from the largest
   to the smallest: what a long document leaves over is absorbed by shorter ones, and one fraction is left at the end.
3. The fractions left are dealt into blocks of the next level by the numbers of their blocks, until a source has one.  It
   gets its copy if that is nearer to the target.

Blocks and draws follow from keys, sizes and `seed` alone, so that reruns agree, whatever the files, splits and partitions.

Cases.  A null text has no words; documents without words change no sum and are taken floor(r) times; a null source is a
source of its own, the last; a null doc_id is a key like any other; repeated rows are units of one key; an empty table gives
no rows.  A source without words has the target 0.  Other columns may have any names: `op11_mixing` does not read them,
`mixed` returns them.
"""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.work import fresh, quoted, small, staged, table
from tallyspark.operators.running import ranged, running

#: Units of a block on average: a hash deals them out.
BLOCK = 1024
#: Rows of equal units that one row is expanded to at most.
CHUNK = 4096
#: Words are what no ASCII white space is in.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(units: DataFrame, weights: list[int], share: float, most: int) -> DataFrame:
    """`units` (source, size) to number, source, source_size, target (double), a row for each source.

    The n-th source by code point, null last, weighs the n-th of `weights`, which repeat.  Sources share `share` of all words by weight,
    none more than `most` times its own; what one cannot take is shared by the others.
    """
    sizes = units.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranks = running(ranged(sizes.select(F.col("source").isNull().alias("last"), "source", "source_size", F.lit(0).alias("all")), ["all"], ["last", "source"]), ["all"], ["last", "source"], {"number": (F.sum, F.lit(1))})
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("number") - 1) % len(weights) + 1).cast("int")).cast("long")
    ranks = staged(ranks.select("number", "source", "source_size", weight.alias("weight")), "sources")
    total = ranks.agg(F.sum("source_size")).first()[0] or 0
    # The level of words for each unit of weight only rises from turn to turn: so do the sources that are full.
    full, before = F.lit(False), None
    while True:
        taken, open_weight, n = ranks.agg(F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        level = (share * total - most * (taken or 0)) / open_weight if open_weight else float("inf")
        if n == before or not open_weight:
            break
        before, full = n, F.col("weight") * F.lit(level) >= most * F.col("source_size")
    target = F.when(full, (most * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.lit(level if open_weight else 0.0))
    return ranks.select("number", "source", "source_size", target.alias("target"))


def swept(rows: list[tuple], draw: random.Random) -> tuple[list[int], tuple[int, float] | None]:
    """`rows` of (size, mass), from the largest to the smallest: the extra copy of each (0 or 1), and the place and mass of the one left over.

    Mass goes from one to the other until one has none or all of its size.
    """
    up, at, mass = [0] * len(rows), None, 0.0
    for j, (size, own) in enumerate(rows):
        if at is None:
            at, mass = j, own
            continue
        gap = rows[at][0] - mass
        gain, loss = min(gap, own), min(mass, size - own)  # what the one left over could get, and give
        if draw.random() * (gain + loss) < loss:
            if own <= gap:
                mass += own
                if mass >= rows[at][0]:
                    up[at], at = 1, None
            else:
                up[at], at, mass = 1, j, own - gap
        elif mass <= size - own:
            at, mass = j, mass + own
            if mass >= size:
                up[j], at = 1, None
        else:
            up[j], mass = 1, mass - (size - own)
    return up, None if at is None else (at, mass)


def _blocks(level: int, last: bool, seed: int):
    """For groups (number, block) of rows in the schema UNIT: the same rows, `up` set but for the one left over."""

    def settle(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("size", "descending"), ("tie", "ascending"), ("unit", "ascending")])
        number, block = (k.as_py() for k in key)
        up, left = swept(list(zip(rows["size"].to_pylist(), rows["mass"].to_pylist())), random.Random(f"{seed}/{level}/{number}/{block}"))
        mass = [0.0] * len(up)
        if left and last:
            up[left[0]] = int(2 * left[1] >= rows["size"][left[0]].as_py())
        elif left:
            up[left[0]], mass[left[0]] = None, left[1]
        names = rows.schema.names
        rows = rows.set_column(names.index("up"), "up", pa.array(up, pa.int32()))
        return rows.set_column(names.index("mass"), "mass", pa.array(mass, pa.float64()))

    return settle


UNIT = "number long, block long, blocks long, unit string, tie long, size long, mass double, up int"


def rounded(units: DataFrame, seed: int) -> DataFrame:
    """`units` (number, unit: a string that tells units of a source apart, size, mass; 0 < mass < size): number, unit, up."""
    tie = F.xxhash64(F.lit(seed), "unit", "size")
    counts = units.groupBy("number").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    rows = units.join(F.broadcast(counts) if counts.limit(10_001).count() <= 10_000 else counts, "number")
    rows = rows.select("number", F.pmod(tie, "blocks").alias("block"), "blocks", "unit", tie.alias("tie"), "size", "mass", F.lit(0).cast("int").alias("up"))
    level, settled = 0, []
    most = rows.agg(F.max("blocks")).first()[0]
    while most:
        done = staged(rows.groupBy("number", "block").applyInArrow(_blocks(level, most == 1, seed), UNIT), "settled")
        settled.append(done.where("up is not null").select("number", "unit", "up"))
        rows = done.where("up is null").withColumn("block", F.floor(F.col("block") / BLOCK)).withColumn("up", F.lit(0).cast("int"))
        level, most = level + 1, 0 if most == 1 else -(-most // BLOCK)
    out = settled[0] if settled else units.select("number", "unit", F.lit(0).alias("up"))
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def copies(rows: DataFrame, weights: list[int], share: float, most: int, seed: int) -> DataFrame:
    """`rows` (staged: unit, source, size): one row for each different (unit, source, size) with `rows`, their number, `base`, the copies that each of them
    gets, `more`, how many of them get one more, source_size and target."""
    sources = staged(targets(rows, weights, share, most), "targets")
    counted = rows.groupBy("source", "unit", "size").agg(F.count("*").alias("rows"))
    to = small(sources)
    met = counted.join(to, counted["source"].eqNullSafe(to["source"])).select(to["number"], counted["source"], "unit", "size", "rows", "source_size", "target")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    met = met.withColumn("ratio", ratio).withColumn("base", F.floor("ratio")).withColumn("part", F.when(F.col("size") > 0, F.col("ratio") - F.col("base")).otherwise(0.0))
    met = staged(met.withColumn("sure", F.floor(F.col("part") * F.col("rows"))), "units")
    open_mass = (F.col("part") * F.col("rows") - F.col("sure")) * F.col("size")
    open_units = met.select("number", F.concat_ws(":", "unit", "size").alias("unit"), "size", open_mass.alias("mass")).where("mass > 0")
    up = staged(rounded(open_units, seed), "rounded")
    x = met.withColumn("key", F.concat_ws(":", "unit", "size"))
    more = F.col("sure") + F.coalesce(up["up"], F.lit(0))
    out = x.join(up, (x["number"] == up["number"]) & (x["key"] == up["unit"]), "left").select(x["unit"], "source", "size", "rows", "base", more.alias("more"), "source_size", "target")
    return staged(out, "copies")


def each(counts: DataFrame, number: Column) -> DataFrame:
    """A row of `counts` as often as `number` says, in chunks, so that no task makes all rows of a hot one."""
    columns = counts.columns
    n, chunk, i = (fresh(columns, c) for c in ("_number", "_chunk", "_i"))
    some = counts.withColumn(n, number)
    many = some.where(F.col(n) > 1).withColumn(chunk, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / CHUNK))))
    many = many.repartition(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    many = many.withColumn(i, F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(CHUNK).cast("long"), F.col(n) - F.col(chunk) * CHUNK))))
    return some.where(F.col(n) == 1).unionByName(many.drop(chunk, i)).drop(n)


def mixed(docs: DataFrame, weights: list[int], share: float = 1.5, most: int = 2, seed: int = 0) -> DataFrame:
    """The mix itself: rows of `docs` (doc_id, text, source), as often as it takes them, columns as they are.

    Rows alike in all columns are units of one key, told apart from others by their doc_id and a hash of all columns.
    """
    key, n = fresh(docs.columns, "_key"), fresh(docs.columns, "_n")
    named = docs.withColumn(key, F.concat_ws(":", quoted("doc_id").cast("string"), F.hex(F.xxhash64(*[quoted(c) for c in docs.columns]))))
    rows = staged(named.select(F.col(key).alias("unit"), "source", words(F.col("text")).alias("size")), "sizes")
    taken = copies(rows, weights, share, most, seed).select(F.col("unit").alias(key), (F.col("rows") * F.col("base") + F.col("more")).alias(n)).where(F.col(n) > 0)
    return each(named.dropDuplicates([key]).join(taken, key), F.col(n)).drop(key, n)


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, and how many of them a mix of half as many words again takes; sources weigh 5, 2, 1, 5, ..."""
    docs = table(spark, sf_dir, "documents")
    rows = staged(docs.select(F.col("doc_id").cast("long").cast("string").alias("unit"), "source", words(F.col("text")).alias("size")), "sizes")
    found = copies(rows, [5, 2, 1], share=1.5, most=2, seed=0)
    columns = [F.col("unit").cast("long").alias("doc_id"), "source", "size", "source_size", "target"]
    taken = lambda n: found.select(*columns, (F.col("size") * n).alias("taken"), "rows", "more")
    plain, again = each(taken(F.col("base")), F.col("rows") - F.col("more")), each(taken(F.col("base") + 1), F.col("more"))
    return plain.unionByName(again).drop("rows", "more")
