"""Families of truncated copies: what the join looks at grows with their members, not with their pairs."""

import os

import numpy as np
import pytest

from tallyspark.llm import jaccard


def family(m):
    """2m whole pages, m without their end, 2m other pages that end like them; each with six words of its own."""
    run = lambda c, a, b: " ".join(f"{c}{k}" for k in range(a, b))
    texts = [run("w", 0, 300)] * (2 * m) + [run("w", 0, 232)] * m + [run("v", 0, 200) + " " + run("w", 224, 300)] * (2 * m)
    return [(i, t + " " + " ".join(f"own{i}x{j}" for j in range(6))) for i, t in enumerate(texts)]


def components(rows, share=75):
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= share * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


@pytest.mark.parametrize("m", [30, 240])
def test_truncated_copies_make_no_pairs(spark, monkeypatch, m):
    seen, turns = [], []
    checked, grouped = jaccard.Join.checked, jaccard.Join.grouped

    def counted(self, pairs, tokens):
        seen.append(pairs.distinct().count())
        return checked(self, pairs, tokens)

    def counted_turn(self, rows, tokens):
        turns.append(rows.where("member").count())
        return grouped(self, rows, tokens)

    monkeypatch.setattr(jaccard.Join, "checked", counted)
    monkeypatch.setattr(jaccard.Join, "grouped", counted_turn)
    rows = family(m)
    got = {r.doc_id: r.component_id for r in jaccard.with_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == (components(rows) if m <= 30 else {i: 0 if i < 2 * m else 2 * m if i < 3 * m else 3 * m for i, _ in rows})
    assert seen[0] <= 16 * len(rows) and len(turns) <= 12


def test_shared_edits_do_not_divide_a_family(spark, monkeypatch):
    """Near copies of one page, each edit in twenty of them: a copy meets few groups but its own, however many edits there are."""
    rows = [(i, " ".join("x" if k == i % 40 + 20 else f"w{k}" for k in range(100)) + f" own{i}") for i in range(800)]
    staged, met = jaccard.staged, []

    def counted(df, name, *more):
        out = staged(df, name, *more)
        if name == "asked":
            met.append(out.where("not own").count())
        return out

    monkeypatch.setattr(jaccard, "staged", counted)
    got = {r.doc_id: r.component_id for r in jaccard.with_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == components(rows)
    assert sum(met) <= 3 * len(rows)


@pytest.mark.parametrize("few", [jaccard.FEW, 8])
def test_few_nodes_are_compared_at_once(spark, monkeypatch, few):
    """Groups of few nodes make no rows for their shingles; larger ones give the same components.  No turn's tables stay."""
    rows, staged, paths = family(30), jaccard.staged, {}

    def noted(df, name, *more):
        out = staged(df, name, *more)
        paths.setdefault(name, []).append(out.staged_at.removeprefix("file:"))
        return out

    monkeypatch.setattr(jaccard, "staged", noted)
    monkeypatch.setattr(jaccard, "FEW", few)
    got = {r.doc_id: r.component_id for r in jaccard.with_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == components(rows)
    assert ("index" in paths) == (few == 8)
    assert not any(os.path.exists(p) for name in ("prefixes", "sizes", "many", "compared", "rows", "met", "asked", "opened", "index", "short", "others") for p in paths.get(name, []))


def test_overlaps_of_sets(monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    rnd = np.random.default_rng(1)
    sets = [np.unique(rnd.integers(0, 60, rnd.integers(1, 40)) ** 2) for _ in range(50)] + [np.arange(10_000, 10_003)]
    assert jaccard.overlaps(sets).tolist() == [[len(np.intersect1d(x, y)) if j > i else 0 for j, y in enumerate(sets)] for i, x in enumerate(sets)]
