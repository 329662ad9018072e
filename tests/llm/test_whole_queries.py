"""Whole queries recomputed from their tables by plain loops, where no SQL can."""

import math
import unicodedata
import zlib
from collections import Counter

import pandas as pd
import xxhash

from tallyspark.llm import toxicity, urls

SF = "/root/testdata/sf0.001"


def test_url_filter(spark):
    pages = pd.read_parquet(f"{SF}/pages.parquet", columns=["page_id", "url"])
    got = {r.page_id: r for r in urls.op2_url_filter(spark, SF).collect()}
    assert len(got) == len(pages)
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    table = []
    for i, url in zip(pages["page_id"], pages["url"]):
        host = path = ""
        if url and "://" in url:
            rest = url[url.index("://") + 3 :]
            host = rest
            for sign in "/?#":
                host = host.split(sign)[0]
            path = rest[len(host) :].split("?")[0].split("#")[0]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [(len(h + p), h + p, v) for h, p, v in rules if ("." + host).endswith("." + h) and path.startswith(p)]
        rule, verdict = max(fit)[1:] if fit else (None, None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        table.append((i, url, verdict))
    letters = "abcdefghijklmnopqrstuvwxyz0123456789./-_"

    def read(url):
        rest = (url or "").partition("://")[2]
        return "^^^" + "".join(c.lower() if c.isascii() and c.lower() in letters else "?" for c in rest)

    seen = {True: Counter(), False: Counter()}
    after = {True: {}, False: {}}
    aside = lambda u: xxhash.xxh64(u.encode(), seed=42).intdigest()
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for _, url, verdict in table:
        if verdict and signed(aside(url)) % 5:
            text = read(url)
            for end in range(3, len(text)):
                for k in range(4):
                    context, c = text[end - k : end], text[end]
                    seen[verdict == "allow"][context + c] += 1
                    after[verdict == "allow"].setdefault(context, Counter())[c] += 1

    def chance(allowed, context, c):
        lower = 1 / 42 if not context else chance(allowed, context[1:], c)
        next_ = after[allowed].get(context)
        if not next_:
            return lower
        return (next_[c] + len(next_) * lower) / (sum(next_.values()) + len(next_))

    def score(url):
        text = read(url)
        each = [math.log(chance(True, text[e - 3 : e], text[e])) - math.log(chance(False, text[e - 3 : e], text[e])) for e in range(3, len(text))]
        return sum(each) / len(each) if each else 0.0

    cut = next(iter(got.values())).cut
    for i, url, verdict in table:
        s = score(url)
        assert abs(s - got[i].score) < 1e-5
        assert got[i].cut == cut and got[i].verdict == (verdict or ("allow" if got[i].score >= cut else "block"))
    marked = [(s.score, verdict == "allow") for (i, url, verdict) in table for s in [got[i]] if verdict and not signed(aside(url)) % 5]

    def wrong(at):
        good, bad = [s for s, a in marked if a], [s for s, a in marked if not a]
        return sum(s < at for s in good) / len(good) + sum(s >= at for s in bad) / len(bad)

    assert wrong(cut) <= min(wrong(k / 50) for k in range(-400, 401)) + 1e-9  # no cell's edge does better


def test_toxicity(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    labels = pd.read_parquet(f"{SF}/labels.parquet").set_index("doc_id")["toxic"].to_dict()
    got = {r.doc_id: r for r in toxicity.op9_toxicity(spark, SF).collect()}
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), toxicity.training_labels(spark, SF))
    assert len(got) == len(docs)
    texts = docs.set_index("doc_id")["text"].to_dict()
    out = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    rows = [(toxicity.fold(texts[i]), y) for i, y in labels.items() if i in texts and not out(i) and y == y]
    p, n = sum(y > 0 for _, y in rows), sum(y == 0 for _, y in rows)
    for term, weight in model.weights.items():
        a, b = sum(term in t for t, y in rows if y > 0), sum(term in t for t, y in rows if y == 0)
        assert abs(weight - (math.log((a + 0.5) / (p + 1)) - math.log((b + 0.5) / (n + 1)))) < 1e-9 and a >= 5 and weight >= 2.5
    bias, by_sum, by_share = model.coefficients
    for i, text in texts.items():
        words = toxicity.fold(text).split()
        both = [(w, "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))) for w in words]
        pairs = [any(f"{a[r]} {b[r]}" in model.exceptions for r in (0, 1)) for a, b in zip(both, both[1:])]
        free = [not (k and pairs[k - 1]) and not (k < len(pairs) and pairs[k]) for k in range(len(words))]
        best = [max((v for t, v in model.weights.items() if any(f" {w} ".startswith(t) for w in two)), default=0) for two in both]
        hits = [b for b, f in zip(best, free) if b and f]
        x = (math.log1p(100 * sum(hits) / (len(words) + 10)), len(hits) / (len(words) + 10)) if hits else (0, 0)
        score = 1 / (1 + math.exp(-(bias + by_sum * x[0] + by_share * x[1])))
        assert abs(score - got[i].score) < 1e-9
        assert got[i].held_out == out(i) and got[i].predicted == int(got[i].score >= 0.7)


def test_toxicity_of_disguised_words():
    for word in ("stupíd", "ｓｔｕｐｉｄ", "ＳＴＵＰＩＤ", "stúpid", "s.t.u.p.i.d", "s t u p 1 d", "5tup1d", "stu​pid", "ѕtupіd", "s-t-u-p-i-d"):
        assert toxicity.readings(toxicity.fold(word))[-1] == " stupid ", word
    assert toxicity.fold("z. B. 1 2 3 4 e.g. U.S.") == " z b e g u s "
    assert toxicity.readings(toxicity.fold("naïve Ärger ñandú")) == (" naïve ärger ñandú ", " naive arger nandu ")


def test_exceptions_are_learned(spark):
    """`clown` speaks for toxicity, but not within `clown fish`; no phrase needs to be given."""
    rows = [(i, f"word{i % 7} you clown here again") for i in range(60)] + [(i, f"word{i % 5} and other things") for i in range(60, 400)] + [(i, "see the clown fish there") for i in range(400, 408)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, least_weight=1.5)
    assert "clown fish" in model.exceptions and "you clown" not in model.exceptions
    asked = spark.createDataFrame([(1, "a clown fish swims"), (2, "what a clown you are")], "doc_id long, text string")
    marks = {r.doc_id: r.toxicity for r in toxicity.scored(asked, model).collect()}
    assert marks[1] < 0.5 < marks[2]
    assert "brave clown" in toxicity.fit(docs, labels, exceptions=("brave clown",)).exceptions
