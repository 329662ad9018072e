"""Repeated runs of lines: later copies are deleted.

Lines with words are numbered by content; a document is a sequence of such numbers.  Suffixes of all sequences are
sorted by prefix doubling: the rank of a line among the repeated lines orders suffixes by their first line, and ranks of
pairs of ranks at a distance of 1, 2, 4 ... order them by 2, 4, 8 ... lines.  A suffix whose first lines occur nowhere
else leaves the sort at once, so that each level is a group-by, a range sort of distinct pairs and joins over what still
repeats.  Suffixes with equal ranks of their first 2^k lines, and equal ranks 2^k before the end of a prefix of m lines,
are the interval of suffixes whose longest common prefix is m lines or more.

A run counts if it has `least_words` words.  Every such run is covered by its shortest prefixes and suffixes (at each of
its lines) that have as many words, and each of those is a run that counts; since no line is without words they have
`least_words` lines at most, so that doubling ends there however long the repeated runs are.  In each interval the
first copy, by doc_id and place, stays; overlapping deletions of a document join to maximal runs.  A run that repeats
into itself keeps its first period.

Cases.  A null text is empty; lines without words neither count nor part a run, and go if lines on both sides go with
one run; a null doc_id comes first; repeated rows are copies like any other (the row read first stays); an empty table
gives no rows.  Other columns may have any names: rows travel packed, so that none of them is renamed, read or lost; only
`text` changes, and `n_chars` where there is one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.work import dropped, light, numbered, quoted, row_key, small, staged, table

LEAST_WORDS = 50
_SPACES = r"[\x20\x09-\x0D]+"
KEY = ["_id", "_text", "_length"]


def words(line):
    return F.size(F.array_remove(F.split(line, _SPACES), ""))


def ranked(pairs: DataFrame, *columns: str) -> DataFrame:
    """Distinct `columns` that occur twice or more, with `rank`, ascending from 1 in their order (not dense)."""
    repeated = pairs.groupBy(*columns).count().where("count > 1").select(*columns)
    return repeated.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("rank", F.monotonically_increasing_id() + 1)


def repeated_runs(docs: DataFrame, least_words: int = LEAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """Of `docs` (doc_id, text, uid): a row for each document (uid, KEY, n_lines), and the runs to delete (uid, KEY, first, last)."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    read = docs.select("uid", *row_key(), F.transform(lines, lambda x, i: F.struct(i.alias("pos"), x.alias("line"), words(x).alias("words"))).alias("lines"))
    read = read.select("uid", *KEY, F.size("lines").alias("n_lines"), F.filter("lines", lambda x: x["words"] > 0).alias("lines"))
    each = read.select("uid", *KEY, "n_lines", F.posexplode_outer("lines").alias("idx", "x"))
    each = staged(each.select("uid", *KEY, "n_lines", "idx", "x.pos", "x.words", F.xxhash64("x.line").alias("h1"), F.hash("x.line").alias("h2")), "lines")
    all_docs = staged(each.where("coalesce(idx, 0) = 0").select("uid", *KEY, "n_lines"), "rows")

    rest = each.where("idx is not null").select("uid", "_id", "idx", "pos", "words", "h1", "h2")
    first_ranks = staged(ranked(rest, "h1", "h2"), "ranks")
    found = rest.join(first_ranks, ["h1", "h2"]).select("uid", "_id", "idx", "pos", "words", "rank")
    stretch = F.col("idx") - F.row_number().over(Window.partitionBy("uid").orderBy("idx"))
    stretches = found.withColumn("stretch", stretch).groupBy("uid", "stretch").agg(F.first("_id").alias("_id"), F.sort_array(F.collect_list(F.struct("idx", "pos", "words", "rank"))).alias("x"))
    total = F.aggregate("x", F.lit(0), lambda a, x: a + x["words"])
    stretches = staged(stretches.where(total >= least_words), "stretches")

    ranks = stretches.select("uid", F.explode("x").alias("x")).select("uid", "x.idx", "x.rank")
    windows = staged(_windows(stretches, least_words), "windows")
    longest = windows.agg(F.max("m")).first()[0] or 0
    classes, p, levels = None, 1, []
    while p <= longest:
        a, b = ranks.select("uid", F.col("idx").alias("at"), F.col("rank").alias("a")), ranks.select("uid", F.col("idx").alias("to"), F.col("rank").alias("b"))
        some = windows.where((F.col("m") >= p) & (F.col("m") < 2 * p)).withColumn("to", F.col("at") + F.col("m") - p)
        some = some.join(a, ["uid", "at"]).join(b, ["uid", "to"]).select("uid", "_id", "at", "first", "last", "m", "a", "b")
        classes = some if classes is None else classes.unionByName(some)
        if 2 * p <= longest:
            pairs = a.withColumn("to", F.col("at") + p).join(b, ["uid", "to"]).select("uid", F.col("at").alias("idx"), "a", "b")
            numbers = staged(ranked(pairs, "a", "b"), "ranks")
            ranks = staged(pairs.join(numbers, ["a", "b"]).select("uid", "idx", "rank"), "level")
            levels += [numbers, ranks]
        p *= 2
    if classes is None:
        classes = windows.select("uid", "_id", "at", "first", "last", "m", F.lit(0).alias("a"), F.lit(0).alias("b"))
    classes = staged(classes, "intervals")
    dropped(each, first_ranks, stretches, windows, *levels)
    place = F.struct("_id", "uid", "at")
    firsts = classes.groupBy("m", "a", "b").agg(F.min(place).alias("origin"), F.count("*").alias("n")).where("n > 1")
    firsts = small(staged(firsts, "firsts"))  # written, so that a hot interval can be split in the join
    later = classes.join(firsts, ["m", "a", "b"]).where(place != F.col("origin")).select("uid", "first", "last").distinct()
    by = Window.partitionBy("uid").orderBy("first", "last")
    reached = F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1))
    runs = later.withColumn("new", (F.col("first") > F.coalesce(reached, F.lit(-2)) + 1).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(by)).groupBy("uid", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return all_docs, staged(runs.join(all_docs, "uid").select("uid", *KEY, "first", "last"), "runs")


def _windows(stretches: DataFrame, least_words: int) -> DataFrame:
    """Shortest runs of `least_words` words that begin or end at each line: uid, _id, at (idx), m (lines), first and last (pos)."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("m"))
    more = lambda a, x: F.when(a["sum"] >= least_words, a).otherwise(F.struct((a["sum"] + x["words"]).alias("sum"), (a["m"] + 1).alias("m")))
    size = F.size("x")
    ahead = lambda i: F.aggregate(F.slice("x", i + 1, F.lit(least_words)), start, more)
    back = lambda i: F.aggregate(F.reverse(F.slice("x", F.greatest(i + 2 - least_words, F.lit(1)), F.least(i + 1, F.lit(least_words)))), start, more)
    places = F.sequence(F.lit(0), size - 1)
    both = F.concat(
        F.transform(places, lambda i: F.struct(i.alias("i"), ahead(i).alias("w"))),
        F.transform(F.transform(places, lambda i: F.struct(i.alias("i"), back(i).alias("w"))), lambda y: F.struct((y["i"] + 1 - y["w"]["m"]).alias("i"), y["w"].alias("w"))),
    )
    each = stretches.select("uid", "_id", "x", F.explode(F.array_distinct(F.transform(F.filter(both, lambda y: y["w"]["sum"] >= least_words), lambda y: F.struct(y["i"].alias("i"), y["w"]["m"].alias("m"))))).alias("y"))
    return each.select("uid", "_id", F.get("x", F.col("y.i"))["idx"].alias("at"), F.col("y.m").alias("m"), F.get("x", F.col("y.i"))["pos"].alias("first"), F.get("x", F.col("y.i") + F.col("y.m") - 1)["pos"].alias("last"))


def with_runs(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """`docs` (row, text, uid) and `deletions`, the array of (first, last) to delete, null if none."""
    listed = runs.groupBy("uid", *KEY).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("deletions"))
    listed = light(staged(listed, "deletions"), F.size("deletions"))
    keyed = docs.select("row", "text", "uid", *row_key())
    same = keyed["uid"] == listed["uid"]
    for c in KEY:
        same = same & keyed[c].eqNullSafe(listed[c])
    return keyed.join(listed, same, "left").select(keyed["row"], keyed["text"], listed["deletions"])


def remaining(text, runs):
    """The text without the lines of its runs."""
    kept = F.filter(F.split(text, "\n"), lambda x, i: ~F.exists(runs, lambda r: (r["first"] <= i) & (i <= r["last"])))
    return F.when(runs.isNull(), text).otherwise(F.array_join(kept, "\n"))


def deduplicated(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """`docs` with their columns, later copies of repeated runs deleted from `text` (and `n_chars` renewed); rows that lose all
    their words that way go."""
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    packed = docs.select(F.struct(*[quoted(c) for c in rest]).alias("row"), "doc_id", "text", (F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)).alias("n_chars"))
    seen = numbered(packed.select(F.struct("row", "n_chars").alias("row"), "doc_id", "text"))
    _, runs = repeated_runs(seen.select("doc_id", "text", "uid"), least_words)
    left = with_runs(seen, runs).withColumn("left", remaining(F.col("text"), F.col("deletions")))
    left = left.where(F.col("deletions").isNull() | (words(F.col("left")) > 0))
    n_chars = F.when(F.col("deletions").isNull(), F.col("row.n_chars")).otherwise(F.length("left"))
    own = {"text": F.col("left"), "n_chars": n_chars}
    return left.select(*[own[c].alias(c) if c in own else F.col("row.row")[c].alias(c) for c in docs.columns])


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document its lines, the lines deleted, their runs (`first-last`, from 0) and the digest of what is left."""
    docs = numbered(table(spark, sf_dir, "documents").select(F.struct("doc_id").alias("row"), "doc_id", "text"))
    _, runs = repeated_runs(docs.select("doc_id", "text", "uid"))
    text = F.coalesce("text", F.lit(""))
    listed = F.array_join(F.transform("deletions", lambda r: F.concat_ws("-", r["first"].cast("string"), r["last"].cast("string"))), ",")
    return with_runs(docs, runs).select(
        F.col("row.doc_id").alias("doc_id"),
        F.size(F.split(text, "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.aggregate("deletions", F.lit(0), lambda a, r: a + r["last"] - r["first"] + 1), F.lit(0)).cast("long").alias("n_deleted"),
        F.coalesce(listed, F.lit("")).alias("runs"),
        F.sha2(remaining(text, F.col("deletions")), 256).alias("text_sha256"),
    )


ORACLE = r"""
WITH all_lines AS (SELECT doc_id, CAST(unnest(range(0, len(l))) AS BIGINT) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
counted AS (SELECT *, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words FROM all_lines),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS idx, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS c FROM counted WHERE words > 0),
spans AS (SELECT a.doc_id, a.idx AS i, b.idx AS j, a.pos AS f, b.pos AS t FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.idx BETWEEN a.idx AND a.idx + 49
          WHERE b.c - a.c + a.words >= 50 AND (b.c - b.words - a.c + a.words < 50 OR b.c - a.c < 50)),
content AS (SELECT s.doc_id, s.i, s.f, s.t, string_agg(l.line, chr(10) ORDER BY l.idx) AS x FROM spans s JOIN l ON l.doc_id = s.doc_id AND l.idx BETWEEN s.i AND s.j GROUP BY s.doc_id, s.i, s.j, s.f, s.t),
copies AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS copy FROM content),
gone AS (SELECT DISTINCT doc_id, unnest(range(f, t + 1)) AS pos FROM copies WHERE copy > 1),
runs AS (SELECT doc_id, min(pos) AS f, max(pos) AS t, count(*) AS n FROM (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM gone) GROUP BY doc_id, g),
listed AS (SELECT doc_id, sum(n) AS n, string_agg(CAST(f AS VARCHAR) || '-' || CAST(t AS VARCHAR), ',' ORDER BY f) AS runs FROM runs GROUP BY doc_id),
texts AS (SELECT a.doc_id, count(*) AS n_lines, coalesce(string_agg(CASE WHEN g.pos IS NULL THEN a.line END, chr(10) ORDER BY a.pos), '') AS x FROM all_lines a LEFT JOIN gone g ON a.doc_id = g.doc_id AND a.pos = g.pos GROUP BY a.doc_id)
SELECT texts.doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_deleted, coalesce(runs, '') AS runs, sha256(x) AS text_sha256 FROM texts LEFT JOIN listed ON texts.doc_id = listed.doc_id
"""
