"""Toxicity by a weighted lexicon that is matched with an Aho-Corasick automaton after folding.

Folding lower-cases, turns letters into their compatibility forms and drops what has no width, maps look-alike letters of
other scripts and digits or signs within words to Latin letters, joins words that are spelled letter by letter, and turns
everything that is no letter into blanks.  Lexicon terms are word beginnings (of `PREFIX` letters) and whole words with
the log-odds of their document frequencies in labelled rows as weights.  They are learned from letters with their accents,
which tell words of a language apart, and looked for with and without them.  A word counts with its heaviest term; words within an exception phrase do not count.  Exceptions are pairs of neighbouring words, one of them of the
lexicon, that stand in `least` harmless rows or more and do not speak for toxicity as a pair; others may be given as
`exceptions`.  The score is the logistic function of the weights' sum, normalised by the text's length, and of the share of
such words, fitted on the same labelled rows.

Bounds.  The fit uses `sample` labelled rows at most (those with the smallest hashes of their doc_id).  Candidate terms are
those in `least_share` of the sample's toxic rows, so their number is bounded by the sample, not by the corpus; the
`terms` heaviest are kept (2,000; on the sf0.1 labels 72 terms pass the weights' limit, so that this bound drops none).  The
automaton, sent to every task, is bounded by them.  Scores cover every row and its whole text.

Cases.  A null or empty text has no words and the score of a text without terms; without labelled rows of both kinds the
score is the smoothed share of toxic labels; labels without doc_id or toxic mark, or for unknown documents, are not used;
of contradicting labels the toxic one holds; repeated doc_ids are scored row by row; an empty table gives no rows, and
without labels at all every score is one half.  `scored` replaces a column named `toxicity`; `without_toxic` packs its rows,
so that no column is renamed, read or lost, whatever its name.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tallyspark.llm.work import quoted, staged, table, with_column

PREFIX = range(4, 13)
#: Look-alikes of Latin letters, fixed values.
HOMOGLYPHS = dict(zip("авекмнорстухіѕјԁԛԝɡαεικνορτυχ", "abekmhopctyxisjdqwgaeiknoptux"))
#: Digits and signs that stand for letters within words, fixed values.
STAND_INS = dict(zip("013457@$!", "oieastasi"))

_THIN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]+")
_MARK = re.compile("[\u0300-\u036f]+")  # those that no letter took up
_SPELLED = re.compile(r"(?<![^\W_])(?:(?:[^\W\d_]|[013457@$!](?=[ ._*-][^\W\d_]))[ ._*-]){3,}[^\W\d_](?![^\W_])")
_STAND_IN = re.compile(r"[013457@$!](?=[^\W\d_])")
_OTHER = re.compile(r"[\W\d_]+")
_LOOKS = str.maketrans(HOMOGLYPHS)


def fold(text: str | None) -> str:
    """Words of folded letters, each with a blank before and after it."""
    if not text:
        return " "
    text = text.lower()
    if not text.isascii():
        text = _MARK.sub("", unicodedata.normalize("NFKC", _THIN.sub("", text))).lower().translate(_LOOKS)
    text = _SPELLED.sub(lambda m: m[0][::2], text)  # a letter and a separator by turns
    text = _STAND_IN.sub(lambda m: STAND_INS[m[0]], text)
    return f" {_OTHER.sub(' ', text).strip()} "


class _Bare(dict):
    """Letters without their accents, by code point."""

    def __missing__(self, point: int) -> int:
        first, *rest = unicodedata.normalize("NFD", chr(point))
        self[point] = ord(first) if rest and all(map(unicodedata.combining, rest)) else point
        return self[point]


_BARE = _Bare()


def readings(folded: str) -> tuple[str, ...]:
    """A folded text, and the same without accents if it has any; letters stand at the same places."""
    bare = folded if folded.isascii() else folded.translate(_BARE)
    return (folded,) if bare == folded else (folded, bare)


def terms_of(text: str | None) -> set[str]:
    """Beginnings and whole words as they stand in the folded text: ` begin` and ` whole `."""
    found = set()
    for word in set(fold(text).split()):
        found.update(f" {word[:k]}" for k in PREFIX if k <= len(word))
        found.add(f" {word} ")
    return found


def pairs_of(text: str | None, automaton) -> set[str]:
    """Neighbouring words of which one begins or is a term of the lexicon."""
    words = fold(text).split()
    hit = [any(True for _ in automaton.iter(f" {w} ")) for w in words]
    return {f"{a} {b}" for a, b, x, y in zip(words, words[1:], hit, hit[1:]) if x or y}


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    coefficients: tuple[float, float, float] = (0.0, 0.0, 0.0)
    exceptions: tuple[str, ...] = ()

    def automaton(self):
        a = ahocorasick.Automaton()
        for t, w in self.weights.items():
            a.add_word(t, (len(t), w))
        for t in self.exceptions:
            a.add_word(f" {fold(t).strip()} ", (len(t) + 2, None))
        if len(a):
            a.make_automaton()
        return a

    def score(self, features: np.ndarray) -> np.ndarray:
        bias, a, b = self.coefficients
        return 1 / (1 + np.exp(-(bias + features @ np.array([a, b]))))


def features(texts, automaton) -> np.ndarray:
    """For each text: logarithm of the weights' sum to 100 words, share of weighted words."""
    out = np.zeros((len(texts), 2))
    for i, text in enumerate(texts):
        folded = fold(text.as_py())
        best: dict[int, float] = {}
        spans = []
        for end, (size, weight) in chain.from_iterable(map(automaton.iter, readings(folded))) if len(automaton) else ():
            start = end - size + 1
            if weight is None:
                spans.append((start, end))
            elif weight > best.get(start, 0):
                best[start] = weight
        for a, b in spans:
            for start in [s for s in best if a <= s < b]:
                del best[start]
        if best:
            words = folded.count(" ") - 1
            out[i] = math.log1p(100 * sum(best.values()) / (words + 10)), len(best) / (words + 10)
    return out


def _count(batches, kept: set[str] | None, found_in=terms_of):
    """Document frequencies of terms in a task's rows; the rows are a bounded sample."""
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0):
            found = found_in(text.as_py())
            counts.update(found if kept is None else found & kept)
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, terms: int = 2_000, least: int = 5, least_share: float = 0.004, least_weight: float = 2.5, exceptions: tuple[str, ...] = ()) -> Model:
    """Learn the lexicon, its exceptions and the score from rows of `labels` (doc_id, toxic); the caller leaves out held-out rows.

    `exceptions` are harmless phrases beside those that the rows show.
    """
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # so it can be sent to every task
    rows = staged(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", (F.col("toxic") > 0).alias("toxic")), "labelled")
    by = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    p, n = by.get(True, 0), by.get(False, 0)
    if not p or not n:
        return Model(coefficients=(math.log((p + 1) / (n + 1)), 0.0, 0.0), exceptions=exceptions)

    def counted(toxic: bool, kept: set[str] | None, least: int, found_in=None) -> dict[str, int]:
        found = rows.where(F.col("toxic") == toxic).select("text").mapInArrow(lambda b: _count(b, kept, found_in() if found_in else terms_of), "term string, n long")
        found = found.groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        return {r.term: r.n for r in found.collect()}  # terms of the bounded sample

    positive = counted(True, None, max(least, int(least_share * p)))
    negative = counted(False, set(positive), 1)
    odds = {t: math.log((k + 0.5) / (p + 1)) - math.log((negative.get(t, 0) + 0.5) / (n + 1)) for t, k in positive.items()}
    model = Model()
    for t in sorted((t for t, w in odds.items() if w >= least_weight), key=lambda t: (len(t), t)):
        shorter = (model.weights.get(t[:k]) for k in range(PREFIX[0] + 1, len(t)))
        if not any(w is not None and w >= odds[t] - 0.7 for w in shorter):  # else the beginning says as much
            model.weights[t] = odds[t]
    model.weights = dict(sorted(model.weights.items(), key=lambda x: (-x[1], x[0]))[:terms])
    lexicon = model.automaton

    def paired():
        automaton = lexicon()
        return lambda text: pairs_of(text, automaton) if len(automaton) else set()

    harmless = counted(False, None, least, paired)
    toxic = counted(True, set(harmless), 1, paired)
    model.exceptions = tuple(sorted({t for t, k in harmless.items() if (toxic.get(t, 0) + 0.5) / (p + 1) <= (k + 0.5) / (n + 1)} | set(exceptions)))
    def measured(batches):
        automaton = lexicon()
        for batch in batches:
            x = features(batch.column(0), automaton)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column(1)], ["a", "b", "toxic"])

    seen = rows.mapInArrow(measured, "a double, b double, toxic boolean").toPandas()  # `sample` rows at most
    model.coefficients = _logistic(seen[["a", "b"]].to_numpy(float), seen["toxic"].to_numpy(float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 30) -> tuple[float, float, float]:
    """Newton's method; the order of the rows does not matter but for rounding."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w.tolist())


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with its columns and `toxicity`, a double from 0 to 1."""
    at = [f.name for f in docs.schema.fields if f.name != "toxicity"].index("text")

    def score(batches):
        automaton = model.automaton()
        for batch in batches:
            yield batch, pa.array(model.score(features(batch.column(at), automaton)), pa.float64())

    return with_column(docs, score, "toxicity", DoubleType())


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where(~held_out())


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's held_out, score and predicted (score of 0.7 or more)."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, training_labels(spark, sf_dir))
    return scored(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted")
    )


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of `docs` below the threshold, with their columns."""
    packed = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), "text")
    return scored(packed, fit(docs, labels)).where(F.col("toxicity") < threshold).select("row.*")
