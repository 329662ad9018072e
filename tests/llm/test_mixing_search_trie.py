"""Operators 11 to 13 against brute force, with nulls, ties, repeated rows, empty tables and clashing names."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import mixing, negatives, trie
from tallyspark.llm.work import staged

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 11: mixing


def filled(sizes: dict, weights, share=1.5, most=2):
    """Targets by pouring what full sources cannot take over the others."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while open_:
        level = (share * sum(sizes.values()) - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > most * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        target |= {s: most * sizes[s] for s in over}
        open_ -= over
    return target


def mix_rows(rnd, n):
    sources = ["a", "b", "é", "zz", None]
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 5, 40, 300])), rnd.choice(sources)) for i in range(n)]
    return rows + [(7, "x y z", "hot")] * n + [(None, "a b", "a"), (None, None, "b"), (3, "same", "a"), (3, "same", "a")]


def copies_of(spark, rows, seed=0, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
    units = staged(df.select(F.col("doc_id").cast("string").alias("unit"), "source", mixing.words(F.col("text")).alias("size")), "t")
    return mixing.copies(units, [5, 2, 1], 1.5, 2, seed)


def test_mix_meets_targets_and_agrees_with_itself(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)  # several levels
    rows = mix_rows(random.Random(1), 600)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    got = copies_of(spark, rows)
    first = rows_of(got)
    assert first == rows_of(copies_of(spark, list(reversed(rows)), parts=7))
    assert first != rows_of(copies_of(spark, rows, seed=1))
    want = filled(sizes, [5, 2, 1])
    taken, units = Counter(), 0
    for r in got.collect():
        assert 0 <= r.base and 0 <= r.more <= r.rows and (r.base + (r.more > 0)) <= 2
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        taken[r.source] += r.size * (r.base * r.rows + r.more)
        units += r.rows
    assert units == len(rows)
    assert all(abs(taken[s] - want[s]) <= 300 for s in want), (taken, want)
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_rounding_keeps_expected_mass():
    """Over many draws each unit gets its copy as often as its mass says; every draw keeps the words."""
    rows = [(90, 30.0), (50, 45.0), (50, 5.0), (20, 10.0), (3, 1.5), (1, 0.5)]
    hits, n = np.zeros(len(rows)), 20_000
    for k in range(n):
        up, left = mixing.swept(rows, random.Random(k))
        given = sum(u * size for u, (size, _) in zip(up, rows)) + (left[1] if left else 0)
        assert given == pytest.approx(sum(m for _, m in rows))
        hits += up
        if left:
            hits[left[0]] += left[1] / rows[left[0]][0]
    assert np.allclose(hits / n, [m / s for s, m in rows], atol=0.02)


def test_mix_repeats_whole_rows_of_any_columns(spark):
    rows = [(i, f"text {i} " + "w " * i, "s" if i % 3 else None, i, "k") for i in range(40)] + [(5, "twin", "s", 0, "k")] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, `size` long, `_key` string")
    got = mixing.mixed(df, [5, 2, 1])
    assert got.columns == df.columns
    count = Counter(tuple(r) for r in got.collect())
    have = Counter(rows)
    assert set(count) <= set(have) and all(count[r] <= 2 * have[r] for r in count)
    words = sum(len(r[1].split()) * n for r, n in count.items())
    assert abs(words - 1.5 * sum(len(r[1].split()) for r in rows)) <= 80
    assert rows_of(mixing.mixed(df.limit(0), [5, 2, 1])) == []


def test_mixing_query(spark):
    got = mixing.op11_mixing(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()
    size = {r.doc_id: len([w for w in (r.text or "").translate({i: " " for i in [*range(9, 14)]}).split(" ") if w]) for r in docs}
    assert sorted(got.doc_id) == sorted(size) and all(size[r.doc_id] == r.size for r in got.itertuples())
    sizes = Counter()
    for r in docs:
        sizes[r.source] += size[r.doc_id]
    want = filled(sizes, [5, 2, 1])
    for source, own in got.groupby("source"):
        assert own.target.iloc[0] == pytest.approx(want[source]) and abs(own.taken.sum() - want[source]) <= own["size"].max()
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got.itertuples())


# 12: hard negatives


def searched(rows, positives=5, negatives_=10):
    """The definition over `rows` (vec_id, vector, label), all in one list."""
    some = []
    for v, x, label in rows:
        if v is not None and label is not None and x is not None and all(c is not None and np.isfinite(c) for c in x):
            some.append((v, np.floor(np.array(x, float) * 256), (label + 1) % 10 if v % 7 == 0 else label))
    dot = lambda a, b: int(np.dot(a[: min(len(a), len(b))], b[: min(len(a), len(b))]))
    out = []
    for i, (v, x, label) in enumerate(some):
        if v % 100:
            continue
        same = sorted((-dot(x, y), w, j) for j, (w, y, m) in enumerate(some) if m == label and j != i)[:positives]
        for s, w, _ in same:
            found = sorted((-dot(x, y), u) for u, y, m in some if m != label and 30 * -s <= 100 * dot(x, y) <= 90 * -s)[:negatives_]
            out += [(v, w, k + 1, u, -s, -t) for k, (t, u) in enumerate(found)]
    return sorted(out)


def vectors(rnd, n, dim=6):
    out = []
    for i in range(n):
        scale = rnd.choice([0.1, 0.5, 1, 3])
        out.append((i, [rnd.gauss(0.3, 1) * scale for _ in range(dim)], rnd.randrange(3)))
    out += [(i + n, list(out[1][1]), 1) for i in range(30)]  # ties
    out += [(200, list(out[200][1]), out[200][2])]  # a repeated anchor
    return out + [(None, [1.0] * dim, 1), (9001, None, 1), (9002, [1.0] * dim, None), (9003, [float("nan")] * dim, 1), (9004, [None] * dim, 2), (9005, [1.0], 2), (9006, [], 0), (-100, [2.0] * dim, 1)]


def test_hard_negatives_equal_the_definition(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 64)
    monkeypatch.setattr(negatives, "CHUNK", 2)
    monkeypatch.setattr(negatives, "GROUP", 2)
    rows = [(v, x if x is None else [None if c is None else float(np.float32(c)) for c in x], label) for v, x, label in vectors(random.Random(3), 900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("uid", F.lit("clash")).repartition(3)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, moved, 30, 90)
    want = searched(rows)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 300
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0, moved, 30, 90).count() == 0
    assert negatives.hard_negatives(df.where("vec_id = 5"), F.col("vec_id") % 100 == 0, moved, 30, 90).count() == 0


# 13: prefix trie


def built(conversations: dict):
    """Nodes of `conversations` (conv_id to its turns' (token, bytes)), from the definition."""
    members = defaultdict(set)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    kids = Counter(k[:-1] for k in members if k)
    out = []
    for k, who in members.items():
        below = [x for x in members if x[: len(k)] == k]
        ends = ",".join(str(c) for c in sorted(who) if len(conversations[c]) == len(k))
        out.append((min(who), len(k), min(members[k[:-1]]) if k else None, len(who), kids[k], sum(not kids[x] for x in below), sum((len(members[x]) - 1) * x[-1][1] for x in below if x), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def turns_of(spark, conversations):
    rows = [(c, d + 1, t, b) for c, turns in conversations.items() for d, (t, b) in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id long, depth long, token string, bytes long").repartition(3), spark.createDataFrame([(c,) for c in conversations], "conv_id long")


@pytest.mark.parametrize("seed, piece, parts", [(1, 4096, 1), (2, 4096, 13), (3, 2, 5), (4, 3, 29)])
def test_trie_equals_the_definition(spark, monkeypatch, seed, piece, parts):
    monkeypatch.setattr(trie, "PIECE", piece)
    monkeypatch.setattr(trie, "IDS", 8)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rnd = random.Random(seed)
        turn = [(hashlib.md5(bytes([i])).hexdigest(), i * 7 + 1) for i in range(3)]
        conversations = {c: [rnd.choice(turn) for _ in range(rnd.choice([0, 1, 2, 4, 6, 9]))] for c in range(-3, 120)}
        conversations |= {500 + i: [turn[0]] * 9 for i in range(60)}  # a third of all, alike
        conversations |= {700 + i: [turn[1]] * 8 + [turn[i % 3]] * i for i in range(6)}
        assert sorted((tuple(r) for r in trie.nodes(*turns_of(spark, conversations)).collect()), key=repr) == built(conversations)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_trie_of_raw_rows(spark):
    """Null and repeated turns, null role and text, clashing columns; conversations whose base is absent; no rows at all."""
    rows = [(5, None, "user", "a"), (5, 1, "user", None), (5, 1, None, "b"), (5, 1, None, "b"), (6, 0, "user", "é" * 9000), (7, 3, "user", "a"), (13, 0, "x", "y"), (13, 1, "x", "z"), (None, 0, "user", "a"), (10, 0, "user", "a"), (14, 0, "q", "r")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("token", F.lit(1)).withColumn("pos", F.lit(1))
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            token = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, token, len(text.encode())))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = turns.get(c - c % 5, [])[:h] + mine[h:]
    got = trie.nodes(*trie.rebuilt(trie.numbered_turns(df)))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == built(whole)
    assert trie.nodes(*trie.rebuilt(trie.numbered_turns(df.limit(0)))).count() == 0
