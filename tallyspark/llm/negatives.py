"""Hard negatives by norm-bucketed search for inner products.

For each anchor the best `positives` rows of its label are found, and for each of these the best `negatives` rows of other
labels whose score lies in a window that the positive's score sets.  Both are one search with windows (no window at first).

1. Candidates are sorted by the bucket of their norm (`STEPS` buckets for each halving, the longest first) and label, and
   stored in blocks of `BLOCK` vectors at most.
2. Buckets are searched in turn.  A score is at most the product of two norms (Cauchy-Schwarz).  So an anchor meets a bucket only if its norm
   times the bucket's largest reaches the window's lower limit and the score that the last of its best has so far; the search
   ends when no anchor does.  Within a bucket, a task keeps the best so far and skips blocks by the same bound.
3. Anchors go in chunks of `CHUNK`; a block meets all chunks that are still open, `GROUP` chunks at a time, so that what is
   sent to every task is bounded.  Scores of a block and a chunk are one matrix product.

Results are exact: vectors are whole numbers in doubles, so products are exact below 2^53.

Cases.  Rows with a null label, vector or vec_id, or any component that is null or not finite, take no part; repeated rows are rows of their
own, so that a copy of an anchor may be its positive; equal scores go by vec_id; shorter vectors are filled with zeros; a vector
without components scores 0; an empty table, or one without anchors, gives no rows.  Columns beside vec_id, embedding
and label are not read, so their names do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.work import dropped, small, staged, table

#: Buckets of norms for each halving, and their number; the last holds all shorter ones.
STEPS, BUCKETS = 4, 48
BLOCK, CHUNK, GROUP = 2048, 256, 64
#: Rounding of norms and their products stays far below this share of them.
SLACK = 1e-9


def prepared(rows: DataFrame) -> DataFrame:
    """`rows` (vec_id, embedding, label) that take part: uid, vec_id, label, vec (whole numbers in doubles), norm, bucket; written once."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label")).where("vec_id is not null and label is not null and embedding is not null").where(finite)
    vec = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    some = some.withColumn("vec", vec).withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)))
    some = staged(some.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "label", "vec", "norm"), "vectors")
    top = some.agg(F.max("norm")).first()[0] or 1.0
    bucket = F.when(F.col("norm") > 0, F.least(F.floor(F.log2(F.lit(top) / F.col("norm")) * STEPS), F.lit(BUCKETS - 1))).otherwise(BUCKETS - 1)
    return some.withColumn("bucket", F.greatest(bucket, F.lit(0)).cast("int"))


def _matrix(column, dim: int) -> np.ndarray:
    """Rows of `column` (lists), filled with zeros up to `dim`."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


BLOCKS = "bucket int, norm double, rows int, vec_ids binary, uids binary, labels binary, vecs binary"


def _blocks(dim: int):
    def made(batches):
        for batch in batches:  # at most BLOCK rows, in order of bucket and label
            at = np.flatnonzero(np.diff(batch.column(5).to_numpy())) + 1
            for lo, hi in zip([0, *at], [*at, len(batch)]):
                part = batch.slice(lo, hi - lo)
                if len(part):
                    ints = [part.column(i).to_numpy().astype("<i8").tobytes() for i in (1, 0, 2)]
                    values = [part.column(5)[0].as_py(), float(part.column(4).to_numpy().max()), len(part), *ints, _matrix(part.column(3), dim).tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.int32(), pa.float64(), pa.int32(), *[pa.binary()] * 4])], ["bucket", "norm", "rows", "vec_ids", "uids", "labels", "vecs"])

    return made


CHUNKS = "chunk long, uids binary, labels binary, norms binary, vecs binary, low binary, high binary"


def _chunk(dim: int, width: int):
    """Anchors of a chunk as matrices; `low` and `high` have a column for each window, empty windows being (inf, -inf)."""

    def made(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        take = lambda n: rows[n].combine_chunks()
        bounds = []
        for name, none in (("low", np.inf), ("high", -np.inf)):
            out = np.full((len(rows), width), none)
            for i, x in enumerate(take(name).to_pylist()):
                for one in x:
                    out[i, one["window"]] = one[name]
            bounds.append(out.tobytes())
        values = [key[0].as_py(), take("uid").to_numpy().astype("<i8").tobytes(), take("label").to_numpy().astype("<i8").tobytes(), take("norm").to_numpy().tobytes(), _matrix(take("vec"), dim).tobytes(), *bounds]
        return pa.table([pa.array([v], t) for v, t in zip(values, [pa.int64(), *[pa.binary()] * 6])], names=["chunk", "uids", "labels", "norms", "vecs", "low", "high"])

    return made


class _Best:
    """The best of one chunk's windows in one task: (score, vec_id, uid), the best first, `k` at most."""

    def __init__(self, row: dict, dim: int, k: int, width: int, same: bool):
        self.uids, self.labels = (np.frombuffer(row[c], "<i8") for c in ("uids", "labels"))
        self.norms, self.vecs = np.frombuffer(row["norms"]), np.frombuffer(row["vecs"]).reshape(-1, dim)
        self.low, self.high = (np.frombuffer(row[c]).reshape(-1, width).copy() for c in ("low", "high"))
        self.k, self.same, self.found = k, same, {}

    def meet(self, norm: float, vec_ids, uids, labels, vecs) -> None:
        ask = self.norms[:, None] * norm * (1 + SLACK) >= self.low
        if self.same:
            ask &= np.isin(self.labels, labels)[:, None]
        some = np.flatnonzero(ask.any(axis=1))
        if not len(some):
            return
        scores = self.vecs[some] @ vecs.T
        fits = self.labels[some][:, None] == labels
        fits = fits & (self.uids[some][:, None] != uids) if self.same else ~fits
        for w in range(self.low.shape[1]):
            rows, cols = np.nonzero(fits & (scores >= self.low[some, w, None]) & (scores <= self.high[some, w, None]))
            if not len(rows):
                continue
            order = np.lexsort((vec_ids[cols], -scores[rows, cols], rows))
            rows, cols = rows[order], cols[order]
            first = np.concatenate([[0], np.flatnonzero(np.diff(rows)) + 1])
            rank = np.arange(len(rows)) - np.repeat(first, np.diff([*first, len(rows)]))
            kept = rank < self.k
            for i in np.split(np.flatnonzero(kept), np.flatnonzero(np.diff(rows[kept])) + 1):
                a = some[rows[i[0]]]
                new = list(zip((-scores[rows[i], cols[i]]).tolist(), vec_ids[cols[i]].tolist(), uids[cols[i]].tolist()))
                best = self.found[a, w] = sorted(self.found.get((a, w), []) + new)[: self.k]
                if len(best) == self.k:
                    self.low[a, w] = max(self.low[a, w], -best[-1][0])

    def rows(self) -> pa.RecordBatch:
        flat = [(self.uids[a], w, -s, v, u) for (a, w), best in self.found.items() for s, v, u in best]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], t) for i, t in enumerate([pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64()])], ["uid", "window", "score", "vec_id", "other"])


FOUND = "uid long, window int, score double, vec_id long, other long"


def _met(dim: int, k: int, width: int, same: bool):
    def search(batches):
        best: dict[int, _Best] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["chunk"] not in best:
                    best[r["chunk"]] = _Best({c: r[f"a_{c}"] for c in ("uids", "labels", "norms", "vecs", "low", "high")}, dim, k, width, same)
                ints = [np.frombuffer(r[c], "<i8") for c in ("vec_ids", "uids", "labels")]
                best[r["chunk"]].meet(r["norm"], *ints, np.frombuffer(r["vecs"]).reshape(-1, dim))
        for b in best.values():
            yield b.rows()

    return search


class Search:
    """Candidates in blocks, met by anchors bucket by bucket."""

    def __init__(self, vectors: DataFrame):
        spark = vectors.sparkSession
        self.vectors = vectors
        self.dim = max(vectors.agg(F.max(F.size("vec"))).first()[0] or 0, 1)
        ordered = vectors.select("uid", "vec_id", "label", "vec", "norm", "bucket").repartitionByRange("bucket", "label", "uid").sortWithinPartitions("bucket", "label", "norm")
        limit, name = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), "spark.sql.execution.arrow.maxRecordsPerBatch"
        spark.conf.set(name, str(BLOCK))
        try:
            self.blocks = staged(ordered.mapInArrow(_blocks(self.dim), BLOCKS), "blocks")
        finally:
            spark.conf.set(name, limit)
        self.tops = {r["bucket"]: r["norm"] for r in self.blocks.groupBy("bucket").agg(F.max("norm").alias("norm")).collect()}  # BUCKETS rows at most

    def best(self, asked: DataFrame, k: int, width: int, same: bool) -> DataFrame:
        """`asked` (staged: uid, label, vec, norm, window, low, high), windows below `width`: the `k` best of each as uid, window, score, vec_id, other, rank.

        `same`: other rows of the same label; otherwise rows of other labels.
        """
        schema, found = FOUND + ", rank int", None
        anchors = asked.select("uid").distinct().count()
        chunks = -(-anchors // CHUNK)
        for bucket, norm in sorted(self.tops.items()):
            now = asked
            if found is not None:
                kth = found.where(F.col("rank") == k).select("uid", "window", F.col("score").alias("kth"))
                now = asked.join(kth, ["uid", "window"], "left").withColumn("low", F.greatest("low", F.coalesce("kth", F.col("low"))))
            now = now.where(F.col("norm") * norm * (1 + SLACK) >= F.col("low"))
            by = now.groupBy(F.pmod(F.xxhash64("uid"), F.lit(max(chunks, 1))).alias("chunk"), "uid").agg(
                *[F.first(c).alias(c) for c in ("label", "vec", "norm")], *[F.collect_list(F.struct("window", c)).alias(c) for c in ("low", "high")])
            open_chunks = staged(by.groupBy("chunk").applyInArrow(_chunk(self.dim, width), CHUNKS), "chunks")
            if not open_chunks.limit(1).count():
                dropped(open_chunks)
                break
            parts = [] if found is None else [found.drop("rank")]
            for first in range(0, chunks, GROUP):
                group = open_chunks.where(F.col("chunk").between(first, first + GROUP - 1)).select("chunk", *[F.col(c).alias(f"a_{c}") for c in open_chunks.columns[1:]])
                some = self.blocks.where(F.col("bucket") == bucket).withColumn("chunk", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(min(chunks, first + GROUP) - 1).cast("long"))))
                parts.append(staged(some.join(F.broadcast(group), "chunk").mapInArrow(_met(self.dim, k, width, same), FOUND), "met"))  # a group has GROUP * CHUNK anchors at most
            every = parts[0]
            for more in parts[1:]:
                every = every.unionByName(more)
            rank = F.row_number().over(_order()).cast("int")
            before, found = found, staged(every.withColumn("rank", rank).where(F.col("rank") <= k), "best")
            dropped(open_chunks, *parts, *([before] if before is not None else []))
        return asked.sparkSession.createDataFrame([], schema) if found is None else found


def _order():
    from pyspark.sql import Window

    return Window.partitionBy("uid", "window").orderBy(F.desc("score"), "vec_id", "other")


def hard_negatives(rows: DataFrame, is_anchor: Column, label: Column, low: int, high: int, positives: int = 5, negatives: int = 10) -> DataFrame:
    """For anchors of `rows` (vec_id, embedding, label), whose label becomes `label`, and each of their first `positives`: the first `negatives` rows of
    other labels with low * positive_score <= 100 * score <= high * positive_score, by score, then vec_id."""
    vectors = prepared(rows.withColumn("label", label))
    search = Search(vectors)
    anchors = staged(vectors.where(is_anchor).select("uid", F.col("vec_id").alias("anchor_id"), "label", "vec", "norm"), "anchors")
    every = staged(anchors.select("uid", "label", "vec", "norm", F.lit(0).alias("window"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high")), "asked")
    found = search.best(every, positives, 1, same=True)
    known = found.select("uid", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").cast("long").alias("positive_score"))
    ends = known.select("*", F.ceil(F.col("positive_score") * low / 100).cast("double").alias("low"), F.floor(F.col("positive_score") * high / 100).cast("double").alias("high"))
    asked = staged(anchors.join(ends.where("low <= high"), "uid"), "windows")
    got = search.best(asked.select("uid", "label", "vec", "norm", "window", "low", "high"), negatives, positives, same=False)
    names = small(staged(asked.select("uid", "window", "anchor_id", "positive_id", "positive_score"), "names"))
    return got.join(names, ["uid", "window"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").cast("long").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten negatives with 30 to 90 percent of the positive's score for each anchor and positive."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, moved, low=30, high=90)


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT * FROM v WHERE vec_id % 100 = 0),
s AS (SELECT a.uid AS anchor, a.vec_id AS anchor_id, b.uid AS other, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM a JOIN v b ON a.uid <> b.uid),
p AS (SELECT anchor, anchor_id, other, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, other) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY s.score DESC, s.vec_id, s.other) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
