"""Prefix trie of conversations by Patricia construction.

A node is a sequence of turns with which some conversation begins.  Only branch, end and leaf points are made while the
conversations are read in sorted order; the unary nodes between two points are one compressed edge until the last step.

1. Turns are numbered within conversations and become 128-bit hashes of role and text.  A conversation is the string of its turns'
   hashes, in pieces of `PIECE` turns, so that no row grows with a conversation; equal pieces are one row with a count.
2. Pieces are sorted and written in ranges.  Two neighbours' common prefix (in turns) is where a branch point lies.  A
   sweep with a stack of open points makes each range's part of the tree, with counts, leaves and saved bytes
   of whole subtrees.
3. A range does not see branches that other ranges make on the paths it shares with them.  They can lie only on the paths of its
   first and last row, and their depths follow from a summary of each range: the common prefixes that are minima from its ends.
   Summaries (a row for each range) pass through the driver; the sweep sets points at these depths.  A turn that ranges
   share is paid for by the first of them.
4. Points of one name are merged: counts, leaves and bytes are summed.  Then edges are expanded: a unary node has the counts of the
   point below it, and adds the sum of the bytes from itself to the end of its edge, times the other members.

Pieces after the first hang under the node that the pieces before them reach; the last pieces are done first, and hand their
sums on.

Cases.  Turns of one number are ordered by their hashes; a null turn comes first; null role or text is empty; repeated rows are turns
of their own; rows without a conv_id belong to no conversation; an empty table has no nodes, not even a root.  Columns beside
conv_id, turn, role and text are not read, so their names do not matter.
"""

from __future__ import annotations

import hashlib
import itertools
import os
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.work import dropped, small, staged, table
from tallyspark.operators.running import ranged, running

#: Turns of a piece at most.
PIECE = 4096
#: Range of conv_ids of which one row holds the text.
IDS = 4096
ROOT = "0" * 32
EMPTY = hashlib.sha256(b"").hexdigest()


def _hex(x: Column) -> Column:
    return F.lpad(F.lower(F.hex(x)), 16, "0")


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """`conversations` (conv_id, turn, role, text) to conv_id, pos (from 1), token, bytes: however many turns one has."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    token = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", token.alias("token"), F.octet_length(text).cast("long").alias("bytes"))
    rows = staged(rows.withColumn("uid", F.monotonically_increasing_id()), "turns")
    order = ["turn", "token", "uid"]
    out = staged(running(ranged(rows, ["conv_id"], order), ["conv_id"], order, {"pos": (F.sum, F.lit(1))}).select("conv_id", "pos", "token", "bytes"), "numbered")
    dropped(rows)
    return out


def pieces(turns: DataFrame, members: DataFrame) -> DataFrame:
    """`turns` (conv_id, depth from 1, token, bytes) and all `members` (conv_id) to conv_id, piece, start (name of the node it hangs under), tokens (hex),
    bytes, end (name of the node it reaches), last."""
    each = turns.groupBy("conv_id", F.floor((F.col("depth") - 1) / PIECE).alias("piece")).agg(F.array_sort(F.collect_list(F.struct("depth", "token", "bytes"))).alias("turns"))
    each = each.select("conv_id", "piece", F.array_join("turns.token", "").alias("tokens"), F.col("turns.bytes").alias("bytes"))
    bare = members.join(turns.where("depth = 1").select("conv_id"), "conv_id", "left_anti")
    each = staged(each.unionByName(bare.select("conv_id", F.lit(0).cast("long").alias("piece"), F.lit("").alias("tokens"), F.array().cast("array<bigint>").alias("bytes"))), "pieces")
    whole = F.size("bytes") == PIECE
    first = each.where("piece = 0").select("*", F.lit(ROOT).alias("start"), F.lit(0).cast("long").alias("more"))
    if each.where("piece > 0").limit(1).count():  # the name of a node that whole pieces reach: an exclusive or of their hashes and places
        marks = [F.xxhash64(F.lit(k), "piece", "tokens") for k in (1, 2)]
        path = Window.partitionBy("conv_id").orderBy("piece")  # a row for PIECE turns
        long = each.select("*", *[F.bit_xor(m).over(path.rowsBetween(Window.unboundedPreceding, -1)).alias(f"x{i}") for i, m in enumerate(marks)], (F.max("piece").over(path.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.col("piece")).alias("more"))
        start = F.when(F.col("piece") == 0, F.lit(ROOT)).otherwise(F.concat(_hex(F.col("x0")), _hex(F.col("x1"))))
        ahead = F.concat(*[_hex(F.coalesce(F.col(f"x{i}"), F.lit(0).cast("long")).bitwiseXOR(m)) for i, m in enumerate(marks)])
        out = long.select("conv_id", "piece", "tokens", "bytes", start.alias("start"), "more", F.when(whole, ahead).alias("ahead"))
    else:
        marks = [_hex(F.xxhash64(F.lit(k), "piece", "tokens")) for k in (1, 2)]
        out = first.select("conv_id", "piece", "tokens", "bytes", "start", "more", F.when(whole, F.concat(*marks)).alias("ahead"))
    name = F.when(F.col("tokens") == "", F.col("start")).otherwise(F.coalesce("ahead", F.md5(F.concat("start", "tokens"))))
    return out.select("conv_id", "piece", "start", "tokens", "bytes", name.alias("end"), (F.col("more") == 0).alias("last"))


def common(x: str, y: str) -> int:
    """Turns that two strings of hashes (32 letters each) share at their beginning."""
    return len(os.path.commonprefix([x, y])) // 32


class _Summary:
    """One sorted range: its first and last row, and the depths that the common prefixes reach as minima from either end."""

    def __init__(self, part: int):
        self.part, self.first, self.last, self.left, self.right = part, None, None, [], []

    def add(self, now: str) -> None:
        if self.first is None:
            self.first = now
        else:
            n = common(self.last, now)
            if not self.left or n < self.left[-1]:
                self.left.append(n)
            while self.right and self.right[-1] >= n:
                self.right.pop()
            self.right.append(n)
        self.last = now

    def batch(self) -> pa.RecordBatch:
        longs = pa.list_(pa.int32())
        values = [(self.part, pa.int32()), (self.first, pa.string()), (self.last, pa.string()), (self.left, longs), (self.right, longs)]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], ["part", "first", "last", "left", "right"])


def _summaries(batches):
    now = None
    for batch in batches:
        for part, start, tokens in zip(*[c.to_pylist() for c in batch.columns]):
            if now is None or part != now.part:
                if now:
                    yield now.batch()
                now = _Summary(part)
            now.add(start + tokens)
    if now:
        yield now.batch()


def contexts(ranges: list) -> dict[int, tuple[int, list[int], int, list[int]]]:
    """`ranges` (part, first, last, left, right; in order) to, for each part, the turns its first row shares with the row before it and all depths of branches
    on its path that ranges before it make; the same of its last row and the ranges after it."""
    out = {r["part"]: [0, [], 0, []] for r in ranges}
    for step, (near, far, mine, at) in {1: ("first", "last", "right", 0), -1: ("last", "first", "left", 2)}.items():
        depths: set[int] = set()
        order = ranges[::step]
        for before, r in zip(order, order[1:]):
            edge = common(before[far], r[near])
            least = min(before[mine], default=None)
            beyond = depths if least is None else {min(least, d) for d in depths}
            depths = {d for d in {edge} | {min(edge, d) for d in beyond | set(before[mine])} if d > 0}
            out[r["part"]][at : at + 2] = [edge, sorted(depths)]
    return {k: tuple(v) for k, v in out.items()}


POINT = "id string, depth long, above string, n long, conv_id long, leaves long, saved long, edge array<bigint>"
FIELDS = pa.schema([("id", pa.string()), ("depth", pa.int64()), ("above", pa.string()), ("n", pa.int64()), ("conv_id", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("edge", pa.list_(pa.int64()))])


class _Point:
    __slots__ = ("depth", "name", "n", "conv", "leaves", "saved", "leaf")

    def __init__(self, depth: int, name: str | None = None):
        self.depth, self.name, self.n, self.conv, self.leaves, self.saved, self.leaf = depth, name, 0, None, 0, 0, False


class Sweep:
    """The compressed tree of one range of sorted pieces, its points going to `rows` as they close.

    Depths count from the node that the pieces hang under, which is 1; `base` is that node's depth in the whole tree.
    """

    def __init__(self, context: tuple, base: int):
        (self.known, self.left, self.edge, self.right), self.base = context, base
        self.path, self.sums, self.shared = None, [], 0
        self.stack: list[_Point] = []
        self.rows: list[tuple] = []

    def name(self, p: _Point) -> str:
        if p.name is None:
            p.name = self.path[:32] if p.depth == 1 else hashlib.md5(self.path[: 32 * p.depth].encode()).hexdigest()
        return p.name

    def close(self) -> None:
        """The last point goes; its edge leads to the one before it."""
        p = self.stack.pop()
        leaves = p.leaves + p.leaf
        if not self.stack:
            self.rows.append((self.name(p), self.base, None, p.n, p.conv, leaves, p.saved, [0]))
            return
        above, s = self.stack[-1], self.sums
        unpaid = max(above.depth, min(self.known, self.shared, p.depth))  # turns before it belong to the range before
        all_turns = lambda lo: p.n * (s[p.depth] - s[lo]) - (s[p.depth] - s[max(lo, unpaid)])
        edge = [s[p.depth - 1] - s[j - 1] for j in range(above.depth + 1, p.depth + 1)]
        saved = p.saved + all_turns(p.depth - 1)
        self.rows.append((self.name(p), self.base + p.depth - 1, self.name(above), p.n, p.conv, leaves, saved, edge))
        above.n, above.leaves, above.leaf, above.saved = above.n + p.n, above.leaves + leaves, False, above.saved + p.saved + all_turns(above.depth)
        above.conv = min(x for x in (above.conv, p.conv) if x is not None)

    def closed_to(self, depth: int) -> None:
        """Close what is below `depth`, where a point opens if an edge leads over it."""
        while self.stack and self.stack[-1].depth > depth:
            if depth and self.stack[-2].depth < depth:
                self.stack.insert(-1, _Point(depth))
            self.close()

    def add(self, start: str, tokens: str, sizes: list[int], end: str, n: int, conv: int, leaves: int, saved: int, goes_on: bool) -> None:
        now, first = start + tokens, self.path is None
        same = 0 if first else common(self.path, now)
        self.closed_to(same)
        self.path, self.sums = now, [0, 0, *itertools.accumulate(sizes)]
        self.shared = len(now) // 32 if first else min(self.shared, same)
        if not self.stack:
            self.stack = [_Point(d) for d in sorted({1, *(self.left if first else ())})]
        if self.stack[-1].depth < len(now) // 32:
            self.stack.append(_Point(len(now) // 32, end))
        p = self.stack[-1]
        p.n, p.conv, p.leaves, p.saved, p.leaf = p.n + n, conv, p.leaves + leaves, p.saved + saved, not goes_on

    def ended(self) -> None:
        if self.edge == len(self.path) // 32:  # the range after this one begins with its last row
            self.stack[-1].leaf = False
        have = {p.depth for p in self.stack}
        self.stack = sorted([*self.stack, *[_Point(d) for d in self.right if d not in have]], key=lambda p: p.depth)
        self.closed_to(0)

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(FIELDS)], schema=FIELDS)


def _points(known: dict, base: int):
    def swept(batches):
        sweep, own = None, None
        for batch in batches:
            for part, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if part != own:
                    if sweep:
                        sweep.ended()
                        yield sweep.taken()
                    sweep, own = Sweep(known[part], base), part
                sweep.add(*row)
            yield sweep.taken()
        if sweep:
            sweep.ended()
            yield sweep.taken()

    return swept


def points(rows: DataFrame, base: int) -> DataFrame:
    """`rows` (start, tokens, bytes, end, n, conv_id, leaves, saved, goes_on; different pieces of one depth) to the points of their compressed tree."""
    parts = staged(rows.repartitionByRange("start", "tokens").withColumn("part", F.spark_partition_id()), "sorted")
    by_part = parts.repartition("part").sortWithinPartitions("part", "start", "tokens")
    ends = by_part.select("part", "start", "tokens").mapInArrow(_summaries, "part int, first string, last string, left array<int>, right array<int>").collect()  # a row for each range
    known = contexts(sorted(ends, key=lambda r: r["part"]))
    found = by_part.select("part", "start", "tokens", "bytes", "end", "n", "conv_id", "leaves", "saved", "goes_on").mapInArrow(_points(known, base), POINT)
    out = staged(found.groupBy("id").agg(*[F.first(c).alias(c) for c in ("depth", "above", "edge")], F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n", "leaves", "saved")]), "points")
    dropped(parts)
    return out


def _ends(batches):
    now, digest = None, None
    names, done = ["end", "ends_sha256"], []
    for batch in batches:
        for end, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if end == now:
                digest.update(b"," + ids.encode())
            else:
                if digest:
                    done.append((now, digest.hexdigest()))
                now, digest = end, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], names)
        done = []
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (now, digest.hexdigest())], names)


def ends(last: DataFrame) -> DataFrame:
    """`last` (end, conv_id) to end and ends_sha256.  Ids of a node are joined by ranges first; a hash takes these texts one after another."""
    texts = last.groupBy("end", F.floor(F.col("conv_id") / IDS).alias("range")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    return texts.repartition("end").sortWithinPartitions("end", "range").select("end", "ids").mapInArrow(_ends, "end string, ends_sha256 string")


def nodes(turns: DataFrame, members: DataFrame) -> DataFrame:
    """`turns` (conv_id, depth from 1, token: 32 hex letters, bytes) of all `members` (conv_id; each once) to the nodes of their trie: conv_id (the smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    each = staged(pieces(turns, members), "named")
    made, below = [], None
    for k in range(each.agg(F.max("piece")).first()[0] or 0, -1, -1):
        rows = each.where(F.col("piece") == k).groupBy("start", "tokens", "end").agg(F.first("bytes").alias("bytes"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.max(~F.col("last")).alias("goes_on"))
        more = [F.lit(0).cast("long").alias(c) for c in ("leaves", "saved")]
        if below is not None:
            rows = rows.join(below, rows["end"] == below["id"], "left").drop("id")
            more = [F.coalesce(c, F.lit(0)).alias(c) for c in ("leaves", "saved")]
        found = points(rows.select("start", "tokens", "bytes", "end", "n", "conv_id", "goes_on", *more), k * PIECE)
        below = found.where("above is null").select("id", "leaves", "saved")
        made.append(found if k == 0 else found.where("above is not null"))
    every = reduce(DataFrame.unionByName, made)
    children = every.where("above is not null").groupBy("above").agg(F.count("*").alias("n_children"))
    above = staged(children.join(every.select("id", "conv_id"), children["above"] == F.col("id")).select("id", "n_children", F.col("conv_id").alias("above_conv")), "branches")
    branch, parent = small(above.select("id", "n_children")), small(above.select(F.col("id").alias("above"), "above_conv"))
    full = every.join(branch, "id", "left").join(parent, "above", "left").join(ends(each.where("last").select("end", "conv_id")).withColumnRenamed("end", "id"), "id", "left")
    at = full.select("*", F.size("edge").alias("size"), F.posexplode("edge").alias("i", "rest"))
    is_point = F.col("i") == F.col("size") - 1
    return at.select(
        "conv_id", (F.col("depth") - F.col("size") + 1 + F.col("i")).alias("depth"), F.when(F.col("i") == 0, F.col("above_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(is_point, F.coalesce("n_children", F.lit(0))).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("saved") + (F.col("n") - 1) * F.col("rest")).alias("saved_tokens"),
        F.coalesce(F.when(is_point, F.col("ends_sha256")), F.lit(EMPTY)).alias("ends_sha256"),
    )


def rebuilt(turns: DataFrame, of: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """`turns` (of `numbered_turns`) of conversations whose first turns are those of another: conversation c begins with the first h of c - c % `of`,
    h being crc32 of c's digits, modulo `heads`, and goes on with its own after its first h.  Returns turns with `depth`, and all conv_ids."""
    sizes = staged(turns.groupBy("conv_id").agg(F.max("pos").alias("n")), "sizes")
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("of_base"))
    convs = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % of).alias("base"), head.alias("h")).join(base, "base", "left")
    convs = small(staged(convs.select("conv_id", "base", "h", F.least("h", F.coalesce("of_base", F.lit(0))).alias("kept")), "convs"))
    own = turns.join(convs, "conv_id").where("base = conv_id or pos > h")
    own = own.select("conv_id", F.when(F.col("base") == F.col("conv_id"), F.col("pos")).otherwise(F.col("kept") + F.col("pos") - F.col("h")).alias("depth"), "token", "bytes")
    first = turns.where(F.col("pos") < heads).withColumnRenamed("conv_id", "base").join(convs, "base").where("base <> conv_id and pos <= h")
    return own.unionByName(first.select("conv_id", F.col("pos").alias("depth"), "token", "bytes")), convs.select("conv_id")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the trie of rebuilt `conversations`."""
    return nodes(*rebuilt(numbered_turns(table(spark, sf_dir, "conversations"))))


ORACLE = """
WITH turns AS (SELECT conv_id, turn, strlen(coalesce(text, '')) AS bytes, md5(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS token FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, token) AS pos FROM turns),
n AS (SELECT conv_id, conv_id - conv_id % 5 AS base, max(pos) AS n,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 9 AS h FROM t GROUP BY conv_id),
c AS (SELECT n.conv_id, n.base, n.h, least(n.h, coalesce(b.n, 0)) AS kept FROM n LEFT JOIN n b ON b.conv_id = n.base),
r AS (SELECT c.conv_id, CASE WHEN c.base = c.conv_id THEN pos ELSE kept + pos - h END AS d, token, bytes FROM t JOIN c ON c.conv_id = t.conv_id WHERE c.base = c.conv_id OR pos > h
  UNION ALL SELECT c.conv_id, pos, token, bytes FROM c JOIN t ON t.conv_id = c.base WHERE c.base <> c.conv_id AND pos <= h),
p AS (SELECT conv_id, d, bytes, string_agg(token, '') OVER (PARTITION BY conv_id ORDER BY d) AS id FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM c),
nodes AS (SELECT id, any_value(d) AS d, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n FROM p GROUP BY id),
kids AS (SELECT left(id, length(id) - 32) AS id, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL),
e AS (SELECT id, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS sha FROM (SELECT conv_id, arg_max(id, d) AS id FROM p GROUP BY conv_id) GROUP BY id),
f AS (SELECT nodes.*, coalesce(k, 0) AS k FROM nodes LEFT JOIN kids ON kids.id = nodes.id),
s AS (SELECT v.id, count(*) FILTER (u.k = 0) AS leaves, sum((u.n - 1) * u.bytes) AS saved FROM f v JOIN f u ON starts_with(u.id, v.id) GROUP BY v.id)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, a.conv_id AS parent_conv_id, CAST(f.n AS BIGINT) AS n_convs, CAST(f.k AS BIGINT) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
FROM f JOIN s ON s.id = f.id LEFT JOIN f a ON f.d > 0 AND a.id = left(f.id, length(f.id) - 32) LEFT JOIN e ON e.id = f.id
"""
