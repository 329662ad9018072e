"""Quotation linking: who answers whom in conversations, and their messages without quotes.

A line's quote level is the number of `>` before its content.  Neighbouring lines of a level of one or more are a
passage.  Lines are normalised (lower case, letters and digits only, single blanks) and hashed; each (conversation, hash)
has one origin, the first turn that says the line in its own words.  A passage comes from the earlier turn that has most
of its lines, if that is half of them or more; a message answers the origin of its longest linked passage of level one
(ties: the later turn).  Paths from the first message of a thread are found by doubling: as many rounds as the logarithm
of the longest chain of quotes.  Sorted by conv_id and path, every message follows the one that it answers.

Quotes are only looked for within their conversation; joins are on conversation and hash with one row on the origins'
side, so that neither long conversations nor common lines multiply rows.

Cases.  A null text is empty; a message with a null conv_id or turn has no links; of messages that share conv_id and
turn the least answer holds for both; a message of quotes only has an empty body; an empty
table gives no rows.  Columns named like the six new ones are replaced; others keep their names and values, whatever they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.work import quoted, staged, table

_MARKS = r"^((?:[ \t]*>)+)"
_NAMED = r"(?i)(wrote|schrieb|a écrit|escribió) ?:\s*$"


def level(line):
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 1), "[^>]", ""))


def content(line):
    return F.regexp_replace(line, _MARKS, "")


def normalised(line):
    return F.trim(F.regexp_replace(F.lower(content(line)), r"[^\p{L}\p{N}]+", " "))


def body(text):
    """The message's own lines, without the line that names whom it quotes."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    own = lambda x, i: (level(x) == 0) & ~(x.rlike(_NAMED) & (F.coalesce(level(F.get(lines, i + 1)), F.lit(0)) > 0))
    return F.regexp_replace(F.array_join(F.filter(lines, own), "\n"), r"^\s+|\s+$", "")


def linked(messages: DataFrame) -> DataFrame:
    """`messages` (conv_id, turn, text) with body, n_quotes and n_linked (passages), reply_to, depth and path (turns from the first)."""
    new = ("body", "n_quotes", "n_linked", "reply_to", "depth", "path")
    rest = [c for c in messages.columns if c not in new]
    packed = F.struct(*[quoted(c) for c in rest]).alias("row")
    kept = staged(messages.select(packed, "conv_id", "turn", "text", F.monotonically_increasing_id().alias("_uid")), "messages")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    each = kept.select("_uid", "conv_id", "turn", F.posexplode(F.transform(lines, lambda x: F.struct(level(x).alias("level"), normalised(x).alias("line")))).alias("pos", "x"))
    each = each.select("_uid", "conv_id", "turn", "pos", "x.level", F.xxhash64("x.line").alias("hash"), (F.length("x.line") > 0).alias("full"))
    each = staged(each, "lines")
    origins = each.where("level = 0 and full").groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    by = Window.partitionBy("_uid").orderBy("pos")
    quotes = each.withColumn("new", (F.col("level") != F.coalesce(F.lag("level").over(by), F.lit(0))).cast("int")).withColumn("passage", F.sum("new").over(by)).where("level > 0")
    found = quotes.where("full").join(origins, ["conv_id", "hash"], "left").withColumn("origin", F.when(F.col("origin") < F.col("turn"), F.col("origin")))
    votes = found.groupBy("_uid", "passage", "level", "origin").count()
    passages = votes.groupBy("_uid", "passage", "level").agg(
        F.sum("count").alias("size"), F.max(F.when(F.col("origin").isNotNull(), F.struct("count", "origin"))).alias("best")
    ).withColumn("best", F.when(2 * F.col("best.count") >= F.col("size"), F.col("best")))
    answers = passages.groupBy("_uid").agg(
        F.count("*").alias("n_quotes"), F.count("best").alias("n_linked"), F.max(F.when(F.col("level") == 1, F.col("best"))).alias("best")
    )
    found = staged(kept.join(answers, "_uid", "left").withColumn("_to", F.col("best.origin")), "answers")
    # `head` is the part of the path already found, `to` the turn that it goes on from, null at the first message.
    tree = found.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min("_to").alias("reply_to"))
    tree = staged(tree.select("conv_id", "turn", "reply_to", F.array("turn").alias("path"), F.col("reply_to").alias("to")), "tree")
    while tree.where("to is not null").limit(1).count():
        above = tree.select("conv_id", F.col("turn").alias("to"), F.col("path").alias("above"), F.col("to").alias("next"))
        step = tree.join(above, ["conv_id", "to"], "left")
        tree = staged(step.select("conv_id", "turn", "reply_to", F.concat(F.coalesce("above", F.array().cast("array<bigint>")), F.col("path")).alias("path"), F.col("next").alias("to")), "tree")
    out = found.join(tree.select("conv_id", "turn", "reply_to", "path"), ["conv_id", "turn"], "left")
    path = F.coalesce("path", F.array("turn"))
    return out.select(
        "row.*",
        body(F.col("text")).alias("body"),
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "reply_to",
        (F.size(path) - 1).cast("long").alias("depth"),
        path.alias("path"),
    )


def op5_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of `conversations` without quotes, whom it answers and its path, in reply order."""
    found = linked(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")).orderBy("conv_id", "path")
    return found.select("conv_id", "turn", "role", "body", "n_quotes", "n_linked", "reply_to", "depth", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"))


ORACLE = r"""
WITH RECURSIVE l AS (SELECT conv_id, turn, role, pos, line, length(regexp_replace(regexp_extract(line, '^((?:[ \t]*>)+)', 1), '[^>]', '', 'g')) AS level,
    trim(regexp_replace(lower(regexp_replace(line, '^((?:[ \t]*>)+)', '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm
  FROM (SELECT conv_id, turn, role, unnest(range(0, len(x))) AS pos, unnest(x) AS line FROM (SELECT conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS x FROM conversations))),
origins AS (SELECT conv_id, norm, min(turn) AS origin FROM l WHERE level = 0 AND norm <> '' GROUP BY conv_id, norm),
marked AS (SELECT *, CASE WHEN level <> coalesce(lag(level) OVER (PARTITION BY conv_id, turn ORDER BY pos), 0) THEN 1 ELSE 0 END AS new,
           coalesce(lead(level) OVER (PARTITION BY conv_id, turn ORDER BY pos), 0) AS after FROM l),
passage AS (SELECT *, sum(new) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS p FROM marked),
votes AS (SELECT q.conv_id, q.turn, q.p, q.level, CASE WHEN origin < q.turn THEN origin END AS origin, count(*) AS n FROM passage q LEFT JOIN origins o ON o.conv_id = q.conv_id AND o.norm = q.norm
          WHERE q.level > 0 AND q.norm <> '' GROUP BY q.conv_id, q.turn, q.p, q.level, CASE WHEN origin < q.turn THEN origin END),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY conv_id, turn, p) AS size, row_number() OVER (PARTITION BY conv_id, turn, p ORDER BY (origin IS NULL), n DESC, origin DESC) AS k FROM votes),
best AS (SELECT conv_id, turn, p, level, n, CASE WHEN 2 * n >= size THEN origin END AS origin FROM ranked WHERE k = 1),
answers AS (SELECT conv_id, turn, count(*) AS n_quotes, count(origin) AS n_linked FROM best GROUP BY conv_id, turn),
to_turn AS (SELECT conv_id, turn, origin FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, origin DESC) AS k FROM best WHERE level = 1 AND origin IS NOT NULL) WHERE k = 1),
bodies AS (SELECT conv_id, turn, role, regexp_replace(coalesce(string_agg(CASE WHEN level = 0 AND NOT (after > 0 AND regexp_matches(line, '(?i)(wrote|schrieb|a écrit|escribió) ?:\s*$')) THEN line END, chr(10) ORDER BY pos), ''), '^\s+|\s+$', '', 'g') AS body
           FROM marked GROUP BY conv_id, turn, role),
tree(conv_id, turn, depth, path) AS (
  SELECT b.conv_id, b.turn, 0, CAST(b.turn AS VARCHAR) FROM bodies b LEFT JOIN to_turn t ON t.conv_id = b.conv_id AND t.turn = b.turn WHERE t.origin IS NULL
  UNION ALL SELECT t.conv_id, t.turn, tree.depth + 1, tree.path || '.' || CAST(t.turn AS VARCHAR) FROM tree JOIN to_turn t ON t.conv_id = tree.conv_id AND t.origin = tree.turn)
SELECT b.conv_id, b.turn, b.role, b.body, CAST(coalesce(a.n_quotes, 0) AS BIGINT) AS n_quotes, CAST(coalesce(a.n_linked, 0) AS BIGINT) AS n_linked, t.origin AS reply_to, CAST(tree.depth AS BIGINT) AS depth, tree.path
FROM bodies b LEFT JOIN answers a ON a.conv_id = b.conv_id AND a.turn = b.turn LEFT JOIN to_turn t ON t.conv_id = b.conv_id AND t.turn = b.turn JOIN tree ON tree.conv_id = b.conv_id AND tree.turn = b.turn
"""
