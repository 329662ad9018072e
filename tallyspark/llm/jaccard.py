"""All pairs of documents whose sets of word shingles have a Jaccard similarity of `share` percent or more, as components.

A set is a node, named by a hash of its shingles, so that exact copies are one node.  The join is exact.  Two sets of n
and m shingles link if their overlap o has (100 + share) * o >= share * (n + m), hence o >= share * n / 100.

1. Lonely nodes go.  Of each node a prefix in hash order is read, long enough that a node with a partner shares some of it
   with others; a shingle of one node alone has the same least and greatest holder.  Most nodes end here.
2. Prefixes.  With counts over all shingles of the remaining nodes, shingles are ordered by rarity; two similar sets share
   one of the first `n - ceil(share * n) + 1` of each.  Cold shingles, of `COLD` nodes at most, give pairs at once.
3. Groups.  For the hot ones the token-group matrix stands in for pairs.  Nodes are grouped by the hot shingle of
   their prefix that most nodes have in theirs.  A group stores the union of its members' shingles with their counts, and its core: what over half of the
   members hold.  A node meets its own group, and larger ones that have a hot shingle of its prefix.
   Where those who meet a group, or all rows of a turn's scope, are `FEW` at most with `FEW_TOKENS` shingles, one task counts
   all their overlaps by products of blocks of the matrix; that costs a node `FEW` overlaps at most, and no further step is needed.
4. Bounds.  A node that meets one of the other groups is encoded against it: c shingles in the core, and those beyond the core that
   others who meet the group hold.  Both together bound its overlap with any member; groups whose bound is too low stay shut.  Where the group
   opens, members x and y overlap in min(c_x, c_y) shingles of the core at most.  So a node whose c alone does not reach
   needs k shingles beyond the core in common with its partner, and only a prefix of these (rarest first) is joined.
   Nodes whose c reaches overlap in c_x + c_y less the core's size at least: where that is enough they link with the
   group's best node without a look at any pair.  Of others, what they lack of the core and have beyond it must agree
   in k entries with their partner; of a prefix of these, cold entries are joined.
5. Hot shingles beyond a core, and hot entries of what nodes lack or have beyond it, make groups within the group in the same way,
   until none is left.  At most half of a group's members have such an entry, since a core is what over half of them hold: so there are
   log2 of the largest group's members turns at most, and copies that lack the same part of a page get a core of their own.
6. Check.  The pairs that these prefixes give are compared shingle by shingle.

So a family of near copies, linked or not, costs rows in proportion to its members.  Shingles and nodes are 64-bit
hashes; two different ones meet with a chance of 5e-20.  Tables are broadcast only if counted to be small.

Cases.  A null or empty text has no shingles and no links; fewer than five words are one shingle; repeated rows are
copies; a null doc_id never names a component unless all its rows lack one; an empty table gives no rows.  Rows are told
apart by doc_id and text, never by a number that another reading could change; of repeated rows one stays.  Other columns
may have any names: none of them is renamed, read or lost.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.components import components
from tallyspark.llm.work import dropped, fresh, light, quoted, small, staged, swept, table

SHINGLE = 5
SHARE = 75
#: A shingle is cold if so many nodes (members of a group) hold it at most: it then gives at most so many pairs a node.
COLD = 16
WORDS_HELD = 400_000
#: So many nodes, with so many shingles in all, are compared in one task, by blocks of so many shingles.
FEW, FEW_TOKENS, BLOCK = 1_024, 1_000_000, 4_096

_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_FACTORS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_LONGS, _COUNTED = "array<bigint>", "array<struct<held:bigint,token:bigint>>"


class _Words(dict):
    """Hashes of words seen by this worker."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS_HELD:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def mixed(x: np.ndarray) -> np.ndarray:
    x = x + _MIX[0]
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(len(h), SHINGLE)
    sums = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        sums += h[k : len(h) - n + 1 + k] * _FACTORS[k]
    return np.unique(mixed(sums).view(np.int64))


def node_of(tokens: np.ndarray) -> int:
    return np.array([xxhash.xxh3_64_intdigest(tokens.tobytes())], np.uint64).view(np.int64)[0]


def least_overlap(n: int, share: int) -> int:
    return -(-share * n // 100)


def prefix(n: int, share: int) -> int:
    """Shingles of a prefix that a node with a partner shares in n // 12 + 1 places: passages in common do not suffice for that."""
    return min(n, n - least_overlap(n, share) + n // 12 + 1)


def _describe(batches, share: int):
    for batch in batches:
        found = [shingles(text.as_py()) for text in batch.column(3)]
        longs = pa.list_(pa.int64())
        made = {
            "n": pa.array(map(len, found), pa.int32()),
            "node": pa.array([node_of(t) if len(t) else None for t in found], pa.int64()),
            "heads": pa.array([t[: prefix(len(t), share)] for t in found], longs),
        }
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made.values()], [*KEY, *made])


def _tokens(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py()) for t in batch.column(1)], pa.list_(pa.int64()))], ["node", "tokens"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """What each two of `sets` (of distinct tokens) have in common, above the diagonal: cold tokens give pairs, others are multiplied in blocks."""
    k = len(sets)
    _, tokens, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(tokens, kind="stable")
    rows, tokens = np.repeat(np.arange(k), [len(x) for x in sets])[order], tokens[order]
    cold, both = held[tokens] <= COLD, np.zeros((k, k), np.float32)
    r, t = rows[cold], tokens[cold]
    for d in range(1, COLD):
        same = np.flatnonzero(t[d:] == t[:-d])
        if not len(same):
            break
        both += np.bincount(r[same] * k + r[same + d], minlength=k * k).reshape(k, k)
    r, t = rows[~cold], np.unique(tokens[~cold], return_inverse=True)[1]
    for i in range(0, len(t) and int(t[-1]) + 1, BLOCK):
        here = slice(*np.searchsorted(t, [i, i + BLOCK]))
        block = np.zeros((k, BLOCK), np.float32)
        block[r[here], t[here] - i] = 1
        both += block @ block.T
    return np.triu(both, 1)


def _compared(group: pa.Table, share: int) -> pa.Table:
    """Of rows (node, tokens) each node that links lead to a lesser one of the rows, with the least: a, b."""
    group = group.sort_by("node").combine_chunks()
    nodes, sets = group["node"].to_numpy(), [np.array(x.values, np.int64) for x in group["tokens"]]
    n = np.array([len(x) for x in sets])
    a, b = np.nonzero(np.triu((100 + share) * overlaps(sets) >= share * (n[:, None] + n), 1))
    least, before = np.arange(len(n)), None
    while before is None or (least != before).any():
        before = least.copy()
        np.minimum.at(least, b, before[a])
        np.minimum.at(least, a, least[b])
        least = least[least]
    far = least < np.arange(len(n))
    return pa.table({"a": nodes[far], "b": nodes[least[far]]})


def _encoded(batches):
    """Of rows (node, g, n, own, size, low, need, tokens, core): c, what is beyond the core, and what of it is lacking if c reaches `need`."""
    for batch in batches:
        c, beyond, lacking = [], [], []
        for need, tokens, core in zip(batch.column(6), batch.column(7), batch.column(8)):
            t, p = np.array(tokens.values, np.int64), np.array(core.values, np.int64)
            inside = np.isin(t, p)
            c.append(int(inside.sum()))
            beyond.append(t[~inside])
            lacking.append(p[~np.isin(p, t)] if c[-1] >= need.as_py() else p[:0])
        longs = pa.list_(pa.int64())
        cores = pa.array([len(x) for x in batch.column(8)], pa.int32())
        yield pa.RecordBatch.from_arrays([*batch.columns[:7], cores, pa.array(c, pa.int32()), pa.array(beyond, longs), pa.array(lacking, longs)], [*batch.schema.names[:7], "core", "c", "beyond", "lacking"])


#: What tells rows of documents apart, wherever and however often they are read.
KEY = ["doc_id", "text_hash", "length"]


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.coalesce(F.length("text"), F.lit(-1)).alias("length"), "text")


def same_row(x, y) -> Column:
    return (x["text_hash"] == y["text_hash"]) & (x["length"] == y["length"]) & x["doc_id"].eqNullSafe(y["doc_id"])


class Join:
    """One run over `docs` (doc_id, text); tables that several steps read are written, and deleted after the last of them."""

    def __init__(self, docs: DataFrame, share: int = SHARE):
        self.docs, self.share, self.spark, self.held = keyed(docs), share, docs.sparkSession, []

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        """`df` staged until its turn of groups ends."""
        self.held.append(staged(df, name))
        return self.held[-1]

    def reaches(self, overlap: Column, sizes: Column) -> Column:
        return (100 + self.share) * overlap >= self.share * sizes

    def fits(self, n: Column, m: Column) -> Column:
        return 100 * F.least(n, m) >= self.share * F.greatest(n, m)

    def least(self, n: str) -> Column:
        return F.ceil(F.lit(self.share) * F.col(n) / 100)

    def described(self) -> tuple[DataFrame, DataFrame]:
        """A row for each document (KEY, n, node); and the nodes that may have a partner, each with all its shingles."""
        share = self.share
        heads = staged(self.docs.mapInArrow(lambda b: _describe(b, share), "doc_id long, text_hash long, length int, n int, node long, heads array<long>"), "heads")
        sets = staged(heads.drop("heads"), "sets")
        held = heads.where("n > 0").select("node", F.explode("heads").alias("token")).groupBy("token").agg(F.min("node").alias("node"), F.max("node").alias("last"))
        alone = staged(held.where("node = last").groupBy("node").agg(F.count("*").cast("int").alias("alone")), "alone")
        nodes = sets.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.min(F.struct(*KEY)).alias("row"))
        some = nodes.join(alone, "node", "left").where(F.coalesce("alone", F.lit(0)) <= F.col("n") - self.least("n")).select("node", "row.*")
        some = staged(some, "some")
        dropped(heads, alone)
        swept(self.spark)
        x, y = self.docs, small(some)
        texts = x.join(y, same_row(x, y)).select(y["node"], x["text"]).groupBy("node").agg(F.first("text").alias("text"))  # repeated rows are one
        tokens = staged(texts.mapInArrow(_tokens, "node long, tokens array<long>"), "tokens")
        dropped(some)
        return sets, tokens

    def prefixes(self, tokens: DataFrame) -> DataFrame:
        """node, n, prefix (held, token; rarest first, without shingles of one node alone) of the nodes that may have a partner."""
        each = tokens.select("node", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
        held = each.groupBy("token").agg(F.count("*").alias("held")).where("held > 1")
        shared = each.join(held.hint("shuffle_hash"), "token").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("held", "token"))).alias("shared"))
        size = F.size("shared") - self.least("n") + 1
        return staged(shared.where(size > 0).select("node", "n", F.slice("shared", F.lit(1), size.cast("int")).alias("prefix")), "prefixes")

    def cold_pairs(self, prefixes: DataFrame) -> DataFrame:
        """Pairs (a, b) that share a cold shingle of their prefixes."""
        each = prefixes.select("node", "n", F.explode(F.filter("prefix", lambda x: x["held"] <= COLD)).alias("x")).select("node", "n", "x.token")
        met = each.groupBy("token").agg(F.sort_array(F.collect_list(F.struct("node", "n"))).alias("met")).where(F.size("met") > 1).select("met").distinct()
        pairs = met.select("met", F.posexplode("met").alias("i", "x")).select("x", F.explode(F.expr("slice(met, i + 2, size(met))")).alias("y"))
        return pairs.where(self.fits(F.col("x.n"), F.col("y.n"))).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()

    def few(self, rows: DataFrame, key: str, tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links (a, b) among `rows` (staged; `key`, node, n) of the keys with few rows, found in one task for each; and the rows of other keys."""
        sizes = rows.groupBy(key).agg((F.count("*") <= FEW).alias("few"), F.sum("n").alias("n")).select(key, (F.col("few") & (F.col("n") <= FEW_TOKENS)).alias("few"))
        sizes, share = small(self.kept(sizes, "sizes")), self.share
        near = rows.join(sizes.where("few"), key).select(F.col(key).alias("g"), "node")
        links = tokens.join(near, "node").groupBy("g").applyInArrow(lambda group: _compared(group.select(["node", "tokens"]), share), "a long, b long")
        return self.kept(links, "compared"), rows.join(sizes.where("not few"), key).drop("few")

    def grouped(self, rows: DataFrame, tokens: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """One turn of groups over `rows` (staged: scope, node, n, member, hot: held and token, rarest first).

        Pairs to find are those of one scope, one end a member, that share a hot shingle.  Returns links (a, b) that need
        no check, pairs to check, and the rows of the next turn, whose scopes are this turn's groups; no pairs and no rows (None) if
        all were compared at once.
        """
        links, rows = self.few(rows, "scope", tokens)
        rows = self.kept(rows, "many")
        if not rows.limit(1).count():
            return links, None, None
        # A member's group is the hot shingle that most members have in their prefixes: edits that a few copies share do not divide a family.
        each = rows.where("member").select("scope", "node", F.explode("hot.token").alias("token"))
        often = small(self.kept(each.groupBy("scope", "token").agg(F.count("*").alias("often")), "often"))
        chosen = each.join(often, ["scope", "token"]).groupBy("scope", "node").agg(F.max(F.struct("often", "token"))["token"].alias("chosen"))
        rows = rows.join(chosen, ["scope", "node"], "left").withColumn("g", F.when(F.col("member"), F.xxhash64("scope", "chosen"))).drop("chosen")
        rows = self.kept(rows, "rows")
        members = rows.where("member")
        groups = self.kept(members.groupBy("g").agg(F.count("*").alias("size"), F.min("n").alias("low"), F.max("n").alias("high")), "groups")
        # The matrix: which group has a hot shingle in a member's prefix.
        hot = rows.join(small(groups.select("g", "size")), "g", "left").select("scope", "node", "n", "g", "size", F.explode("hot").alias("x")).select("scope", "node", "n", "g", "size", "x.token")
        matrix = members.select("scope", "g", F.explode("hot").alias("x")).select("scope", "g", "x.token").distinct().join(small(groups), "g")
        matrix = self.kept(matrix.select("scope", "token", F.col("g").alias("h"), F.col("size").alias("others"), "low", "high"), "matrix")
        fit = (100 * F.col("high") >= self.share * F.col("n")) & (100 * F.col("n") >= self.share * F.col("low"))
        larger = F.col("g").isNull() | (F.struct("others", "h") > F.struct("size", "g"))  # of two groups, the smaller one's members ask
        asked = hot.join(small(matrix), ["scope", "token"]).where(larger & fit).select("node", "n", F.col("h").alias("g"), F.lit(False).alias("own")).distinct()
        asked = self.kept(asked.unionByName(members.select("node", "n", "g", F.lit(True).alias("own"))), "met")
        near, asked = self.few(asked, "g", tokens)
        links = links.unionByName(near)
        asked = self.kept(asked, "many")
        if not asked.limit(1).count():
            return links, None, None
        members = members.join(F.broadcast(asked.select("g").distinct()), "g", "left_semi")  # few groups have many rows
        # What the groups store: counts of the union, and the core.
        union = tokens.join(small(members.select("node", "g")), "node").select("g", F.explode("tokens").alias("token")).groupBy("g", "token").agg(F.count("*").alias("held"))
        union = self.kept(union.join(small(groups.select("g", "size")), "g"), "union")
        cores = union.where("2 * held > size").groupBy("g").agg(F.collect_list("token").alias("core"))
        cores = self.kept(groups.join(cores, "g", "left").select("g", "size", "low", F.coalesce("core", F.array().cast(_LONGS)).alias("core")), "cores")
        need = F.ceil(self.share * (F.col("n") + F.greatest(self.least("n"), "low")) / (100 + self.share)).cast("int")
        asked = tokens.join(small(asked), "node").join(light(cores, F.size("core")), "g").select("node", "g", "n", "own", "size", "low", need.alias("need"), "tokens", "core")
        asked = asked.mapInArrow(_encoded, "node long, g long, n int, own boolean, size long, low int, need int, core int, c int, beyond array<long>, lacking array<long>")
        asked = self.kept(asked, "asked")
        around = asked.select("g", "own", F.explode("beyond").alias("token")).groupBy("g", "token").agg(F.count_if("own").alias("held"), F.count("*").alias("seen"))
        beyond = self.counted(asked, "beyond", around.where("held > 0 and seen > 1"), F.col("held"))
        opened = asked.drop("beyond").join(beyond, ["node", "g"], "left").withColumn("beyond", F.coalesce("beyond", F.array().cast(_COUNTED)))
        opened = opened.withColumn("over", F.size("beyond")).where(F.col("c") + F.col("over") >= F.col("need"))
        opened = opened.withColumn("free", F.col("c") >= F.col("need")).withColumn("w", (100 + self.share) * F.col("c") - self.share * F.col("n"))
        opened = self.kept(opened, "opened")
        # Free nodes link with the best of them where that is certain.
        best = small(self.kept(opened.where("free").groupBy("g").agg(F.max(F.struct("w", "node")).alias("best")), "best"))
        opened = opened.join(best, "g", "left")
        reached = F.col("free") & (F.col("w") + F.col("best.w") >= (100 + self.share) * F.col("core"))
        opened = opened.withColumn("linked", F.coalesce(reached, F.lit(False)))
        sure = opened.where("linked and node <> best.node").select(F.col("node").alias("a"), F.col("best.node").alias("b"))
        # Others need shingles beyond the core in common.
        size = F.when(F.col("free"), F.col("over")).otherwise(F.col("over") - (F.col("need") - F.col("c")) + 1)
        index = opened.select("g", "node", "n", "own", "linked", "c", "over", F.expr("cast(0 as int)").alias("short"), F.slice("beyond", F.lit(1), size.cast("int")).alias("prefix"))
        index = self.kept(index.where(F.size("prefix") > 0), "index")
        rest = index.select(F.col("g").alias("scope"), "node", "n", F.col("own").alias("member"), F.filter("prefix", lambda x: x["held"] > COLD).alias("hot"))
        lacking, more = self.lacking(opened, union)
        return links.unionByName(sure), self.met(index, index).unionByName(lacking), rest.unionByName(more).where("size(hot) > 0")

    def counted(self, rows: DataFrame, name: str, counts: DataFrame, count: Column) -> DataFrame:
        """node, g and the list `name` of `rows`, as (held, token) in order of `count`; only tokens of `counts` (g, token)."""
        each = rows.select("node", "g", F.explode(name).alias("token")).join(counts, ["g", "token"])
        return each.groupBy("node", "g").agg(F.sort_array(F.collect_list(F.struct(count.alias("held"), "token"))).alias(name))

    def met(self, index: DataFrame, others: DataFrame) -> DataFrame:
        """Pairs of rows of a group that share a cold entry of their prefixes, if bounds allow a link; a further turn takes up the hot ones."""
        kept = lambda x: x["held"] <= COLD
        columns = ["g", "node", "n", "own", "linked", "c", "over", "short"]
        each = lambda df: df.select(*columns, F.explode(F.filter("prefix", kept)).alias("x")).select(*columns, "x.token")
        x, y = each(index).alias("x"), each(others.where("own")).alias("y")
        once = (F.col("x.node") < F.col("y.node")) | ~F.col("x.own") | (F.col("x.short") == 1)
        most = F.least("x.c", "y.c") + F.least("x.over", "y.over")
        fit = self.fits(F.col("x.n"), F.col("y.n")) & self.reaches(most, F.col("x.n") + F.col("y.n"))
        on = (F.col("x.g") == F.col("y.g")) & (F.col("x.token") == F.col("y.token"))
        met = x.join(y, on & once & fit & (F.col("x.node") != F.col("y.node")) & ~(F.col("x.linked") & F.col("y.linked")))
        return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()

    def lacking(self, opened: DataFrame, union: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of free nodes of a group, one end not linked with its best, that agree in what they lack or have beyond the core: pairs that share a cold
        entry, and rows of a turn for the hot ones."""
        whole = (100 + self.share) * F.col("core")
        left = self.kept(opened.where("free and not linked").groupBy("g").agg(F.max("w").alias("left")), "left")
        some = opened.where("free").join(small(left), "g")
        # What a node lacks has the other sign, and counts the members that lack it.
        lacks = self.counted(some, "lacking", union, F.col("size") - F.col("held"))
        signed = F.concat(
            F.transform("beyond", lambda x: F.struct(x["held"].alias("held"), F.xxhash64(F.lit(1), x["token"]).alias("token"))),
            F.transform(F.coalesce("lacks", F.array().cast(_COUNTED)), lambda x: F.struct(x["held"].alias("held"), F.xxhash64(F.lit(0), x["token"]).alias("token"))),
        )
        some = some.drop("lacking").join(lacks.withColumnRenamed("lacking", "lacks"), ["node", "g"], "left").withColumn("all", F.sort_array(signed))
        index = lambda rows, most: rows.withColumn("k", F.greatest(F.ceil((whole - F.col("w") - most) / (100 + self.share)), F.lit(1)).cast("int")).where("size(all) >= k").select(
            "g", "node", "n", "own", "linked", "c", "over", F.lit(1).alias("short"), F.slice("all", F.lit(1), F.size("all") - F.col("k") + 1).alias("prefix")
        )
        x, y = self.kept(index(some.where("not linked"), F.col("best.w")), "short"), self.kept(index(some, F.col("left")), "others")
        # The best is at least as good as the best of those not linked: of a node not linked, the first prefix holds the second.
        ends = x.unionByName(y.where("linked"))
        rest = ends.select(F.xxhash64(F.lit("signed"), "g").alias("scope"), "node", "n", F.col("own").alias("member"), F.filter("prefix", lambda e: e["held"] > COLD).alias("hot"))
        # One of the two is a member of the group.
        return self.met(x, y).unionByName(self.met(y, x)).distinct(), rest

    def checked(self, pairs: DataFrame, tokens: DataFrame) -> DataFrame:
        """Of `pairs` (a, b) those that link."""
        pairs = staged(pairs.distinct(), "pairs")
        ends = small(staged(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends"))
        some = tokens.join(ends, "node")
        x, y = some.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), some.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
        met = x.join(small(pairs), "a").join(y, "b").select("a", "b", (F.size("ta") + F.size("tb")).alias("sizes"), F.size(F.array_intersect("ta", "tb")).alias("both"))
        return staged(met.where(self.reaches(F.col("both"), F.col("sizes"))).select("a", "b"), "links")

    def classes(self, tokens: DataFrame) -> DataFrame:
        """node and root for all nodes with a link to another node."""
        prefixes = self.prefixes(tokens)
        swept(self.spark)
        links, pairs = [], [staged(self.cold_pairs(prefixes), "pairs")]
        hot = F.filter("prefix", lambda x: x["held"] > COLD)
        rows = staged(prefixes.select(F.lit(0).cast("long").alias("scope"), "node", "n", F.lit(True).alias("member"), hot.alias("hot")).where("size(hot) > 0"), "hot")
        dropped(prefixes)
        while rows is not None and rows.limit(1).count():
            before = rows
            # Each turn's results are written, so that its tables and shuffles can go.
            sure, more, rows = self.grouped(rows, tokens)
            links.append(staged(sure, "sure"))
            if more is not None:
                pairs.append(staged(more, "pairs"))
                rows = staged(rows, "hot")
            dropped(before, *self.held)
            self.held.clear()
            swept(self.spark)
        every = self.checked(reduce(DataFrame.unionByName, pairs), tokens)
        for x in links:
            every = every.unionByName(x)
        return staged(components(every), "classes")


def with_components(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """For every row of `docs` (doc_id, text): KEY, n_shingles, component_id, the least doc_id that links reach, and root, the component's node."""
    join = Join(docs, share)
    sets, tokens = join.described()
    classes = join.classes(tokens)
    dropped(tokens)
    rooted = sets.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first")).join(classes, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    rooted = staged(rooted, "rooted")
    names = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("node", "root", "component_id")
    return sets.join(names, "node", "left").select(*KEY, F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "root")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of shingles and component."""
    return with_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """The rows of `docs`, one for each component: one with its least doc_id, of those the one with the least text hash; columns as they are.

    Rows without shingles stay all.
    """
    found = staged(with_components(docs, share).where("n_shingles > 0"), "found")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), *KEY)).alias("kept"))
    x = found.join(first, "root").select(*KEY, F.col("kept.doc_id").alias("doc"), F.col("kept.text_hash").alias("hash"), F.col("kept.length").alias("long"))
    stays = x["doc_id"].eqNullSafe(x["doc"]) & (x["text_hash"] == x["hash"]) & (x["length"] == x["long"])
    marked = staged(x.groupBy(*KEY).agg(F.max(stays).alias("stays"), F.count("*").alias("rows")).where("not stays or rows > 1"), "marked")
    names = {c: fresh(docs.columns, f"_{c}") for c in KEY}
    rows = docs.select(*[quoted(c) for c in docs.columns], *[c.alias(names[k]) for k, c in zip(KEY, (F.col("doc_id").cast("long"), F.xxhash64("text"), F.coalesce(F.length("text"), F.lit(-1))))])
    gone = small(marked.select(*KEY))
    same = (rows[names["text_hash"]] == gone["text_hash"]) & (rows[names["length"]] == gone["length"]) & rows[names["doc_id"]].eqNullSafe(gone["doc_id"])
    left = rows.join(gone, same, "left_anti").select(*[quoted(c) for c in docs.columns])
    twice = marked.where("stays")
    if twice.limit(1).count():  # repeated rows: one of them stays
        again = small(twice.select(*KEY))
        same = (rows[names["text_hash"]] == again["text_hash"]) & (rows[names["length"]] == again["length"]) & rows[names["doc_id"]].eqNullSafe(again["doc_id"])
        left = left.unionByName(rows.join(again, same, "left_semi").dropDuplicates(list(names.values())).select(*[quoted(c) for c in docs.columns]))
    return left


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
sym AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, sym.b FROM r JOIN sym ON r.b = sym.a),
reach AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, reach.c AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN reach ON reach.a = w.doc_id
"""
