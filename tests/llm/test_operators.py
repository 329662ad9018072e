"""The training-data operators against brute force, round trips and planted cases, with nulls, ties and clashing columns."""

import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import components, decontamination, jaccard, line_dedup, packing, quality, quotation, secrets, tokens, toxicity, urls
from tallyspark.llm.work import fresh_path, staged

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = [f"w{i}" for i in range(400)]


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def docs(spark, rows, schema="doc_id long, text string"):
    return staged(spark.createDataFrame(rows, schema).repartition(3), "test")


EDGES = [(1, None), (2, ""), (3, "one"), (None, "two words\nhere"), (3, "one"), (5, "  \n\n"), (6, "ünï漢 " * 300)]


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def test_token_files_round_trip(spark):
    rows = [*EDGES, (9, "It's a test, isn't it?  3.5\t<|endoftext|>")]
    path = fresh_path(spark, "t")
    tokens.write_tokens(docs(spark, rows), path, public_tokenizers.path("word_bpe_49k.json"), 2, "words", partitions=3)
    got = sorted(tokens.read_tokens(spark, path).collect(), key=lambda r: r.start)
    t = library("word_bpe_49k.json")
    want = sorted(((i is not None, i or 0), zlib.crc32(np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4"))) for i, x in rows)
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(i for i, _ in rows if i is not None)


def test_packing_keeps_every_id_once(spark):
    rnd = random.Random(1)
    rows = [*EDGES[:3], *[(100 + i, prose(rnd, rnd.choice([3, 200, 900, 4000]))) for i in range(40)]]
    t = library("byte_bpe_50k.json")
    ids = {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4") for i, x in rows}
    got = packing.packed_documents(docs(spark, rows)).toPandas()
    for i, own in got.sort_values("start").groupby("doc_id"):
        assert own.start.tolist() == [0, *own.length.cumsum()[:-1]] and own.length.sum() == len(ids[i])
        assert all(zlib.crc32(ids[i][r.start : r.start + r.length]) == r.ids_crc32 for r in own.itertuples())
    own = got.sort_values(["sequence_id", "offset"])
    assert (own.groupby("sequence_id").length.cumsum() - own.length == own.offset).all()
    filled = own.groupby("sequence_id").length.sum()
    assert filled.max() <= 2048 and filled.sum() / (2048 * len(filled)) > 0.9 and set(got.doc_id) == set(ids)


#: The contract's expressions of the base kinds, group and least length; those of the method are the rules' own.
EXACT = {
    "assign": ("(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6),
    "access": ("AKIA[A-Z0-9]+", 0, 20),
    "hex": ("[0-9a-f]+", 0, 24),
}


def spans_by_expressions(text):
    raw, want = (text or "").encode(), []
    for k, rule in enumerate(secrets.RULES):
        exact, group, least = EXACT.get(rule.kind, (rule.whole, 0, rule.least))
        for m in re.finditer(exact.encode(), raw):
            if m.end(group) - m.start(group) >= least:
                want.append((len(raw[: m.start()].decode()), k, rule.kind, len(raw[: m.end()].decode())))
    return [(a, kind, b) for a, _, kind, b in sorted(want)]


def test_secrets_against_expressions(spark, tmp_path):
    rnd = random.Random(3)
    parts = ["password", "Secret", "token", "api_key", " ", ":", "=", '"', "AKIA", "ABCD1234", "abcdef0123456789", "é", "漢", "\n", "ghp_", "-----BEGIN ", "PRIVATE KEY-----", ",", "ſ", "eyJ", ".", "xoxb-", "AIza"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    texts += [None, "", "secret=token:abcdefgh", "token = 'ab' password: x=y==zzz", prose(rnd, 20_000) + " token=" + "a" * 30]
    rows = list(enumerate(texts))
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.secrets] for r in secrets.with_secrets(docs(spark, rows)).collect()}
    assert all(got[i] == spans_by_expressions(x) for i, x in rows)
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    for r in secrets.op3_secrets(spark, str(tmp_path)).collect():
        want = spans_by_expressions(texts[r.doc_id])
        base = [f"{k}:{a}:{b}" for a, k, b in want if k in EXACT]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for _, kind, _ in want) for k in EXACT)
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and r.spans == ",".join(f"{k}:{a}:{b}" for a, k, b in want)


@pytest.mark.parametrize("unit", ["eyJ", "a0", "token=", "-----BEGIN ", "AKIA", "x"])
def test_secrets_of_a_text_of_one_megabyte(unit):
    text, began = unit * (1_000_000 // len(unit)) + ".eyJx.y", time.time()
    found = secrets._find(pa.array([text]), secrets.Finder())[0]
    assert time.time() - began < 20 and len(found) <= 2  # time in proportion to the text


def counted_plainly(text):
    words = re.findall("[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    repeated = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


def test_quality_query_against_counts(spark, tmp_path):
    rnd = random.Random(12)
    lines = [prose(rnd, k) for k in (1, 3, 7)]
    rows = [(i, "\n".join(rnd.choice([*lines, prose(rnd, 9), "#| x", ""]) for _ in range(rnd.randint(0, 9))), rnd.choice(["en", None]), rnd.choice(["a", "b"])) for i in range(150)]
    rows += [(200, None, "en", "a"), (201, "", None, None), (None, "one", "de", "c"), (202, "é 漢 " * 30, "fr", "a")]
    docs(spark, rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in quality.op4_quality(spark, str(tmp_path)).collect()}
    for i, text, *_ in rows:
        n = counted_plainly(text)
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == n
        assert got[i].base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and not (got[i].base_failed and got[i].kept)


def test_quality_outliers(spark):
    rnd = random.Random(2)
    rows = [(i, prose(rnd, 120), "en" if i % 2 else None, "s", 1) for i in range(400)] + [(900 + i, " ".join(w + "###" for w in prose(rnd, 120).split()), "en", "s", 1) for i in range(20)]
    stats = quality.statistics(docs(spark, rows, "doc_id long, text string, lang string, source string, outlier int")).withColumn("base_failed", F.col("n_words") < 10)
    gone = {r.doc_id for r in quality.outliers(staged(stats.withColumn("row", F.lit(1)).withColumn("outlier", F.lit(5)), "s")).where("outlier").collect()}
    assert gone == {900 + i for i in range(20)}


def test_least_determinants_against_all_subsets(spark):
    rng, rows = np.random.default_rng(4), []
    for g in range(12):
        x = rng.normal(0, 1, (12, 4)) @ rng.normal(0, 1, (4, 4))
        x[: g % 4] += 20  # none to three strays
        rows += [(f"g{g}", r.tolist()) for r in x]
    rows += [("one", [0.0] * 4), ("two", [1.0] * 4), ("two", [2.0] * 4)]
    fits = {r.grp: r for r in quality.estimates(staged(spark.createDataFrame(rows, "grp string, x array<double>"), "x")).collect()}
    near = quality.chi2_quantile(0.75, 4)
    factor = 0.75 / quality.chi2_cdf(near, 6)
    best = 0
    for g in range(12):
        x = np.array([r for k, r in rows if k == f"g{g}"])
        least = min(np.linalg.slogdet(quality.scatter((x[list(c)].T @ x[list(c)] / 9).ravel(), x[list(c)].mean(axis=0), 9, factor))[1] for c in itertools.combinations(range(12), 9))
        assert least - 1e-9 <= fits[f"g{g}"].logdet <= least + 0.7
        best += fits[f"g{g}"].logdet < least + 1e-6
        assert np.abs(np.array(fits[f"g{g}"].centre)).max() < 8  # strays do not pull it
    assert best >= 8 and {"one", "two"} <= set(fits)


def test_url_rules_and_models(spark):
    rows = [(i, f"http://a{i % 7}.example.net/{'en' if i % 2 else 'fr'}/{i}", None) for i in range(200)]
    rows += [(900, None, None), (901, "nothing", None), (902, "HTTP://X.Org/fr/1?q#z", None), (903, "x://net", None), (904, "x://b.com/en/1", None)]
    df = docs(spark, rows, "page_id long, url string, score string").select("page_id", "url", urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path"))
    df = df.withColumn("fit", urls.ruled())
    got = {r.page_id: r for r in df.select("page_id", "host", "path", "fit.rule", "fit.verdict").collect()}
    assert (got[900].host, got[900].path, got[900].rule) == ("", "", None) and got[901].host == ""
    assert (got[902].host, got[902].path, got[902].rule, got[902].verdict) == ("x.org", "/fr/1", "org/fr/", "allow")
    assert got[903].rule is None and got[1].rule == "example.net/en/" and got[2].rule == "net/"
    scored, cut = urls.with_ratio(df.select("page_id", "url", F.col("fit.verdict").alias("verdict")))
    s = {r.page_id: r.score for r in scored.collect()}
    assert s[900] == 0 and min(s[i] for i in range(1, 200, 2)) > cut > max(s[i] for i in range(0, 200, 2))


def test_log_probabilities_sum_to_one():
    counts = np.zeros(urls.SYMBOLS**urls.ORDER, np.int64)
    counts[np.random.default_rng(1).integers(0, len(counts), 500)] = 3
    p = np.exp(urls.log_probabilities(counts)).reshape(-1, urls.SYMBOLS).sum(axis=1)
    assert np.allclose(p, 1)


def test_repeated_runs_against_brute_force(spark):
    rnd = random.Random(5)
    lines = [prose(rnd, rnd.choice([1, 3, 20, 60])) for _ in range(25)] + ["", "  "]
    rows = [(i, "\n".join(rnd.choice(lines) for _ in range(rnd.randint(1, 12))), i) for i in range(60)] + [(99, None, 0), (100, "", 0)]
    df = line_dedup.numbered(docs(spark, rows, "doc_id long, text string, runs int"))
    _, runs = line_dedup.repeated_runs(df.select("doc_id", "text", "uid"))
    got = {(r.doc_id, i) for r in runs.select(F.col("_id").alias("doc_id"), "first", "last").collect() for i in range(r.first, r.last + 1)}
    seen, want = set(), set()
    for i, text, _ in rows:
        full = [(k, x) for k, x in enumerate((text or "").split("\n")) if x.split()]
        spans = []
        for a in range(len(full)):
            for b in range(a, len(full)):
                n = [len(x.split()) for _, x in full[a : b + 1]]
                if sum(n) >= 50 and (sum(n[:-1]) < 50 or sum(n[1:]) < 50):
                    spans.append((full[a][0], full[b][0], tuple(x for _, x in full[a : b + 1])))
        for first, last, x in sorted(spans):
            if x in seen:
                want.update((i, k) for k in range(first, last + 1))
            seen.add(x)
    assert got == want and got
    left = line_dedup.deduplicated(docs(spark, rows, "doc_id long, text string, n_chars int"))
    assert left.columns == ["doc_id", "text", "n_chars"] and {99, 100} <= {r.doc_id for r in left.collect()}


def components_by_brute_force(rows):
    """doc_id to (n_shingles, component_id), for distinct doc_ids."""
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (x or "").lower().split()) else set() for _, x in rows]
    number = {t: k for k, t in enumerate(set().union(*sets))}
    held = np.zeros((len(rows), len(number)), np.float32)
    for k, s in enumerate(sets):
        held[k, [number[t] for t in s]] = 1
    n, both = held.sum(axis=1), held @ held.T
    linked = (both > 0) & (4 * both >= 3 * (n[:, None] + n[None, :] - both))
    root = np.arange(len(rows))
    while True:  # the least label spreads over links
        now = np.minimum(root, np.where(linked, root[None, :], len(rows)).min(axis=1))
        if (now == root).all():
            break
        root = now
    out = {}
    for k, (i, _) in enumerate(rows):
        out[i] = int(n[k]), min((rows[j][0] for j in np.flatnonzero(root == root[k]) if rows[j][0] is not None), default=None)
    return out


@pytest.mark.parametrize("cold", [16, 4])
def test_jaccard_components_against_brute_force(spark, monkeypatch, cold):
    monkeypatch.setattr(jaccard, "COLD", cold)
    rnd = random.Random(cold)
    bases, passage, rows = [prose(rnd, 50).split(), prose(rnd, 80).split()], prose(rnd, 30).split(), []
    bases.append([*bases[1][:60], *prose(rnd, 20).split()])  # two families with most of their words in common
    for i in range(160):
        if i % 4 < 3:
            d = list(bases[i % 4])
            for _ in range(rnd.randint(0, 4)):
                d[rnd.randrange(len(d))] = rnd.choice(WORDS)
            if rnd.random() < 0.3:
                d = d[: rnd.randint(40, len(d))]
        else:
            d = prose(rnd, rnd.randint(0, 15)).split() + passage + prose(rnd, rnd.randint(0, 15)).split()
        rows.append((500 - i, " ".join(d)))
    rows += [(900, None), (901, "  "), (None, "a b"), (902, "A  B"), (7, rows[3][1])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.with_components(docs(spark, rows)).collect()}
    assert got == components_by_brute_force(rows)


def test_jaccard_family_without_links(spark):
    rnd = random.Random(4)
    base, rows = prose(rnd, 100).split(), []
    for i in range(2000):  # each has edits of its own: alike in most words, linked with few
        d = list(base)
        for k in rnd.sample(range(100), rnd.choice([2, 3, 4, 5])):
            d[k] = f"own{i}x{k}"
        rows.append((i, " ".join(d)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.with_components(docs(spark, rows)).collect()}
    assert got == components_by_brute_force(rows)


CLASHES = ["_uid", "uid", "_id", "_text", "_length", "text_hash", "length", "node", "root", "stays", "a.b"]


def test_one_of_each_keeps_columns_and_ties(spark):
    rnd = random.Random(6)
    text, other = prose(rnd, 60), prose(rnd, 60)
    rows = [(1, text), (1, text), (1, text + " end"), (None, other), (None, other), (None, None), (None, None), (4, prose(rnd, 30))]
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` long" for c in CLASHES)
    df = docs(spark, [(*r, *range(100 * k, 100 * k + len(CLASHES))) for k, r in enumerate(rows)], schema)
    got = jaccard.one_of_each(df)
    assert got.columns == df.columns
    left = [tuple(r) for r in got.collect()]
    assert all(r[2:] == tuple(range(r[2], r[2] + len(CLASHES))) for r in left)
    assert sorted((str(r[0]), str(r[1])[:20]) for r in left) == sorted([("1", text[:20]), ("None", other[:20]), ("None", "None"), ("None", "None"), ("4", rows[-1][1][:20])])


def test_row_numbers_outlive_changes_of_file_splits(spark, monkeypatch, tmp_path):
    rnd = random.Random(3)
    family, run = prose(rnd, 120), prose(rnd, 60)
    rows = [(i, f"{family} w{i}" if i < 20 else f"{prose(rnd, 70)}\n{run}" if i < 40 else prose(rnd, 90)) for i in range(80)]
    (tmp_path / "d").mkdir()
    path = str(tmp_path / "d" / "documents.parquet")
    docs(spark, rows).repartition(8).write.parquet(path)
    turn = iter(range(10_000))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def staged_with_other_splits(*args):
        out = staged(*args)
        spark.conf.set("spark.sql.files.maxPartitionBytes", ("1k", "64m")[next(turn) % 2])
        return out

    for m in (jaccard, line_dedup):
        monkeypatch.setattr(m, "staged", staged_with_other_splits)
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        found = {r.doc_id: r.component_id for r in jaccard.op7_jaccard_join(spark, str(tmp_path / "d")).collect()}
        kept = {r.doc_id for r in jaccard.one_of_each(spark.read.parquet(path)).collect()}
        left = {r.doc_id: r.text for r in line_dedup.deduplicated(spark.read.parquet(path)).collect()}
        runs = {r.doc_id: r.n_deleted for r in line_dedup.op6_line_dedup(spark, str(tmp_path / "d")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == {i: 0 if i < 20 else i for i in range(80)}
    assert kept == {0, *range(20, 80)}
    assert {i for i in range(20, 40) if run in left[i]} == {20}
    assert {i for i in runs if runs[i]} == set(range(21, 40))


def test_components_of_a_chain(spark):
    edges = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    assert {(r.node, r.root) for r in components.components(edges).collect()} == {(i, 0) for i in range(60)}


def test_decontamination_against_brute_force(spark):
    rnd = random.Random(8)
    items = [("a", prose(rnd, 40)), ("b", prose(rnd, 13)), ("c", "Short one"), ("d", None), (None, prose(rnd, 20)), ("e", "solo")]
    passage = items[0][1].split()
    texts = [prose(rnd, 60) + " " + " ".join(passage[5:25]) + " " + prose(rnd, 100), " ".join(passage[:12]), "x short-ONE y", None, "", items[4][1].upper(), prose(rnd, 30) + " solo"]
    rows = list(enumerate(texts))
    got = {r["_id"]: r for r in decontamination.contamination(docs(spark, rows), docs(spark, items, "item_id string, text string")).collect()}
    split = lambda x: [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (x or "").lower()) if w]
    for i, text in rows:
        w, hit, found = split(text), set(), set()
        for k, x in items:
            v = split(x)
            n = min(13, len(v))
            grams = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)} if v else set()
            for j in range(len(w) - n + 1):
                if n and tuple(w[j : j + n]) in grams:
                    hit.update(range(j, j + n))
                    found.add(k or "")
        assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == (len(w), len(hit), sorted(found))


def test_toxicity_folds_and_separates(spark):
    assert toxicity.fold("Ѕtup1d  L0SER 12") == " stupid loser "
    rnd = random.Random(9)
    rows = [(i, prose(rnd, 30) + (" m0ron clowns" if i % 4 == 0 else "")) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(150)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, rows), labels)
    marks = {r.doc_id: r.toxicity for r in toxicity.scored(docs(spark, [*rows, (900, None), (901, "trash can")], "doc_id long, text string"), model).collect()}
    assert all((marks[i] >= 0.7) == (i % 4 == 0) for i in range(200)) and 0 <= marks[900] < 0.7
    assert toxicity.fit(docs(spark, rows), labels.where("toxic = 0")).weights == {}


def test_quotations(spark):
    rows = [
        (1, 0, "user", "Shall we meet?\nI can do Monday."), (1, 1, "assistant", "> shall we MEET\n> I can do Monday!\nYes."), (1, 2, "user", "Bob wrote:\n> > Shall we meet?\n> Yes.\nGood"), (1, 3, "x", None),
        (1, 4, "x", "> never said\nhm"), (2, 0, "user", "> Yes.\n\n"), (None, 1, "u", "> a"),
    ]
    got = {(r.conv_id, r.turn): r for r in quotation.linked(docs(spark, rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1, 1].reply_to, got[1, 1].body, got[1, 1].n_linked) == (0, "Yes.", 1)
    assert (got[1, 2].reply_to, got[1, 2].body, got[1, 2].path, got[1, 2].n_quotes) == (1, "Good", [0, 1, 2], 2)
    assert got[1, 4].reply_to is None and got[1, 4].n_quotes == 1 and got[2, 0].body == "" and got[1, 3].body == ""


#: Names that operators use inside, or give to their results.
NAMES = ["_uid", "uid", "_id", "_text", "_length", "deletions", "toxicity", "score", "body", "path", "row", "best", "left", "node", "outlier", "secrets", "verdict", "lang", "source", "a.b", "Text_", "n_chars"]


def clashing(spark, texts):
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` long" for c in NAMES)
    return docs(spark, [(i, t, *range(100 * i, 100 * i + len(NAMES))) for i, t in enumerate(texts)], schema)


@pytest.mark.parametrize("name", ["jaccard", "lines", "benchmark", "toxicity", "secrets"])
def test_columns_of_any_name_stay(spark, name):
    rnd = random.Random(7)
    run = prose(rnd, 60)
    texts = [prose(rnd, 80), prose(rnd, 50) + "\n" + run, run + "\n" + prose(rnd, 50), None, "", prose(rnd, 30)]
    df = clashing(spark, texts)
    items = spark.createDataFrame([("x", prose(rnd, 30))], "item_id string, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    out = {"jaccard": lambda: jaccard.one_of_each(df), "lines": lambda: line_dedup.deduplicated(df), "benchmark": lambda: decontamination.without_contaminated(df, items), "toxicity": lambda: toxicity.without_toxic(df, labels, 2.0), "secrets": lambda: secrets.with_secrets(df)}[name]()
    changed = {"lines": ["n_chars"], "secrets": ["secrets"]}.get(name, [])
    assert sorted(out.columns) == sorted(df.columns)
    rows = out.collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert all(r[c] == 100 * r.doc_id + k for k, c in enumerate(NAMES) if c not in changed)
        assert r.text == texts[r.doc_id] or (name == "lines" and r.doc_id == 2)


def test_messages_and_pages_with_columns_of_any_name(spark):
    m = docs(spark, [(1, 0, "Hi there all", 5, 6), (1, 1, "> Hi there all\nYes", 7, 8)], "conv_id long, turn long, text string, best long, origin long")
    assert {(r.turn, r.reply_to, r.best, r.origin) for r in quotation.linked(m).collect()} == {(0, None, 5, 6), (1, 0, 7, 8)}
    p = docs(spark, [("http://a.net/x", "block", "s", 1)], "url string, verdict string, score string, gram long")
    scored, _ = urls.with_ratio(p)
    assert scored.columns == ["url", "verdict", "gram", "score"] and scored.first().gram == 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    items = spark.createDataFrame([], "item_id string, text string")
    assert packing.packed_documents(none).count() == 0
    assert line_dedup.deduplicated(none).count() == 0 and jaccard.one_of_each(none).count() == 0
    assert decontamination.without_contaminated(none, items).count() == 0
    assert quality.outliers(staged(quality.statistics(none).withColumn("base_failed", F.lit(False)), "s")).count() == 0
    path = fresh_path(spark, "t")
    tokens.write_tokens(none, path, public_tokenizers.path("word_bpe_49k.json"), 2, "words")
    assert tokens.read_tokens(spark, path).count() == 0
    assert urls.with_ratio(spark.createDataFrame([], "url string, verdict string"))[0].count() == 0
    assert secrets.with_secrets(none).count() == 0 and toxicity.without_toxic(none, labels).count() == 0
    assert quotation.linked(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    some = docs(spark, [(1, "a b"), (2, None)])
    assert decontamination.without_contaminated(some, items).count() == 2 and toxicity.without_toxic(some, labels).count() == 2


@pytest.mark.parametrize("name, split", [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "spaces")])
def test_pieces_are_looked_at_once(name, split):
    """Many texts of few words: the library gets each word once, without separators where ends show, and ids are those of whole texts."""
    import public_tokenizers
    from tallyspark.llm.encoding import Encoder

    tool, rnd = Encoder(public_tokenizers.path(name), split), random.Random(3)
    odd = ["don't", "İstanbul", "été", "straße", "Ǆ", "x1", "</w>", "a</w>", "ﬁn", "各自", "Ⅷ", "ʰa", "한국", "a,b", "...", "ẞ", "ᾳ", "l'été", "😀"]
    vocabulary = odd + ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 9))) for _ in range(3_000)]
    texts = ["", " ", "\n\n", *odd, *(rnd.choice(["", " "]) + rnd.choice([" ", "  ", "\n", ". "]).join(rnd.choices(vocabulary, k=400)) for _ in range(40))]
    assert tool.encode(texts) == tool.whole(texts)
    if split == "words":
        seen, several = [], tool.several
        tool.several = lambda pieces, between, *more: (seen.append((len(pieces), between)), several(pieces, between, *more))[1]
        tool.cache = {"": b""}
        assert tool.encode(["ab cd ab", "CD ab\tef."]) == tool.whole(["ab cd ab", "cd ab ef."]) and (3, " ") in seen
