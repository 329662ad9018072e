"""Benchmark decontamination: a prefix-filtered join of texts with windows of benchmark words.

A window is `WINDOW` consecutive words of an item (all of a shorter item).  A window's tokens are its shingles of
`SHINGLE` words.  Shingles are ordered by their number in the documents; since a window must be contained whole, its
prefix is its rarest shingle alone.  Documents are read once: their shingles meet those of the benchmark (broadcast if
counted to be few, shuffled otherwise), which leaves one row for each meeting and one for each document.  From these
rows come the frequencies, the candidates (places of prefix shingles at which the window lies within the document) and
the exact check: all shingles of the window stand at their places.  Nothing but meetings is shuffled.

Cases.  A null or empty text has no words and no hits; a null item text has no window; null item_ids count as an item
named by the empty string; repeated items share their windows and are listed each; repeated documents are judged one by
one; an empty table on either side gives no hits.  Other columns may have any names: rows travel packed, so that none of
them is renamed, read or lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.work import lowered, quoted, row_key, small, staged, table

WINDOW = 13
SHINGLE = 5
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_EMPTY = "array<bigint>"


def words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), _BETWEEN), "")


def shingles(hashes: Column, n: Column, size: int | Column, most: int) -> Column:
    """Numbers of all runs of `size` words; `size` may be a column of `most` at most."""
    part = lambda i, k: F.get(hashes, i + F.lit(k))
    if isinstance(size, int):
        number = lambda i: F.xxhash64(F.lit(size), *[part(i, k) for k in range(size)])
        return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), number)).otherwise(F.lit(None).cast(_EMPTY))
    found = F.lit(None).cast(_EMPTY)
    for s in range(1, most + 1):
        found = F.when(size == s, shingles(hashes, n, s, most)).otherwise(found)
    return found


def windows_of(items: DataFrame) -> DataFrame:
    """wid, item_id, size (words), span (words of a shingle), tokens (shingles in order), for every window of every item."""
    words_of = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(WINDOW))
    each = words_of.select("item_id", size.alias("size"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size))).alias("w"))
    each = each.withColumn("span", F.least("size", F.lit(SHINGLE))).withColumn("hashes", F.transform("w", lambda x: F.xxhash64(x)))
    return each.select(F.xxhash64("hashes").alias("wid"), "item_id", "size", "span", shingles(F.col("hashes"), F.col("size"), F.col("span"), SHINGLE).alias("tokens"))


def meetings(docs: DataFrame, tokens: DataFrame, spans: list[int]) -> DataFrame:
    """A row for each document (token 0, pos -1) and for each of its shingles that is among `tokens` (token, span)."""
    read = docs.select(F.monotonically_increasing_id().alias("uid"), *row_key(), words(F.col("text")).alias("w"))
    read = read.select("uid", "_id", "_text", "_length", F.size("w").alias("n_words"), F.transform("w", lambda x: F.xxhash64(x)).alias("hashes"))
    each = [F.coalesce(shingles(F.col("hashes"), F.col("n_words"), s, s), F.array().cast(_EMPTY)) for s in spans]
    exploded = read.select("uid", "_id", "_text", "_length", "n_words", F.posexplode(F.concat(F.array(F.lit(0).cast("bigint")), *each)).alias("place", "token"))
    ahead, before = F.lit(1), F.lit(0)
    for s in spans:  # a span's shingles stand behind those of the spans before it
        before = F.when(F.col("span") == s, ahead).otherwise(before)
        ahead = ahead + F.greatest(F.col("n_words") - (s - 1), F.lit(0))
    pos = F.when(F.col("span") == 0, -1).otherwise(F.col("place") - before)
    return exploded.join(tokens, "token").select("uid", "_id", "_text", "_length", "n_words", pos.alias("pos"), "token")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """For every row of `docs` (doc_id, text): its key (`row_key`), n_words, n_hit and the sorted list `items` that hit it."""
    spark = docs.sparkSession
    windows = staged(windows_of(items), "windows")
    spans = sorted(r.span for r in windows.select("span").distinct().collect())  # SHINGLE numbers at most
    tokens = windows.select(F.explode("tokens").alias("token"), "span").distinct()
    mark = spark.range(1).select(F.lit(0).cast("bigint").alias("token"), F.lit(0).alias("span"))
    tokens = staged(tokens.unionByName(mark), "tokens")
    met = staged(meetings(docs, small(tokens), spans), "meetings")
    all_docs, found = met.where("pos < 0"), met.where("pos >= 0").select("uid", "n_words", "pos", "token")

    counts = found.groupBy("token").count()
    distinct = windows.select("wid", "size", "span", "tokens").dropDuplicates(["wid"])
    rarity = distinct.select("wid", "size", F.posexplode("tokens").alias("at", "token")).join(counts, "token", "left")
    prefix = rarity.groupBy("wid").agg(
        F.first("size").alias("size"), F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "at", "token")).alias("rarest")
    ).where("rarest.n > 0")  # else a shingle of it is nowhere
    prefix = staged(prefix.select("wid", "size", F.col("rarest.at").alias("at"), F.col("rarest.token").alias("token")), "prefixes")
    start = F.col("pos") - F.col("at")
    candidates = found.join(small(prefix), "token").where((start >= 0) & (start + F.col("size") <= F.col("n_words"))).select("uid", "wid", "size", start.alias("start"))
    tokens_of = distinct.select("wid", F.posexplode("tokens").alias("at", "token"), F.size("tokens").alias("needed"))
    wanted = candidates.join(tokens_of, "wid").select("uid", "wid", "size", "start", "needed", (F.col("start") + F.col("at")).alias("pos"), "token")
    whole = wanted.join(found.select("uid", "pos", "token"), ["uid", "pos", "token"]).groupBy("uid", "wid", "size", "start", "needed").count().where("count = needed")
    whole = staged(whole.select("uid", "wid", "size", "start"), "hits")

    reached = F.max(F.col("start") + F.col("size")).over(Window.partitionBy("uid").orderBy("start", "size", "wid").rowsBetween(Window.unboundedPreceding, -1))
    end = F.col("start") + F.col("size")
    new = F.greatest(end - F.greatest("start", F.coalesce(reached, F.lit(0))), F.lit(0))
    hits = whole.select("uid", new.alias("new")).groupBy("uid").agg(F.sum("new").alias("n_hit"))
    named = whole.select("uid", "wid").distinct().join(windows.select("wid", "item_id").distinct(), "wid").select("uid", "item_id").distinct()
    named = named.groupBy("uid").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    return all_docs.join(hits, "uid", "left").join(named, "uid", "left").select(
        "_id", "_text", "_length", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def contaminated() -> Column:
    """One word in twenty is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of `benchmark` windows in every whole text of `documents`."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), contaminated().alias("contaminated")
    )


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` that are not contaminated, with their columns."""
    bad = staged(contamination(docs, items).where(contaminated()).select("_id", "_text", "_length").distinct(), "contaminated")
    keyed = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), *row_key())
    same = [keyed[c].eqNullSafe(bad[c]) for c in ("_id", "_text", "_length")]
    return keyed.join(small(bad), same[0] & same[1] & same[2], "left_anti").select("row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
lens AS (SELECT DISTINCT least(len(w), 13) AS size FROM b WHERE len(w) > 0),
win AS (SELECT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS t
        FROM (SELECT item_id, w, least(len(w), 13) AS size, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS t
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, lens WHERE len(w) >= size)),
hit AS (SELECT DISTINCT doc_id, dw.size, i, item_id FROM dw JOIN win ON dw.t = win.t AND dw.size = win.size),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS p FROM hit),
n AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN m ON d.doc_id = m.doc_id
"""
