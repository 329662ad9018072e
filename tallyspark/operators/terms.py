"""Correcting terms that were read wrongly: a weighted distance with suffixes, over a lexicon of any size.

Terms and lexicon words meet by length only where a distance within reach allows it, in blocks; a block of terms of one length and a block
of words of one length are compared at once.  A lower bound from counts of letters leaves few pairs, and the distance runs over
all of these together, cell by cell of the table, not pair by pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.names import simplify
from tallyspark.operators.documents import CONFUSED
from tallyspark.sources.scratch import written

#: A distance counts as near up to this share of the term's length (one at least); the best must be better than the next by the margin.
SHARE, MARGIN = 0.34, 0.30
#: What each letter costs that is taken off an ending.
PER_LETTER = 0.05
#: Turkish endings after accents are gone (fixed values).
ENDINGS = [
    "sinden", "sindan", "larindan", "lerinden", "sinin", "larin", "lerin", "sinde", "sina", "sine", "sini", "lari", "leri", "nin", "nun", "den", "dan", "ten", "tan",
    "lar", "ler", "de", "da", "te", "ta", "si", "su", "in", "un", "ni", "nu", "ye", "ya", "yi", "yu", "i", "u", "e", "a",
]
TERMS_HELD, WORDS_HELD = 512, 2048

_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "
_CODE = np.full(128, len(_LETTERS), np.int64)
_CODE[[ord(c) for c in _LETTERS]] = np.arange(len(_LETTERS))
#: Confusable letters are of one class: swapping them leaves a word's counts of classes as they are.
_CLASS = np.array([next((min(_LETTERS.index(x) for x in s) for s in CONFUSED if c in s), i) for i, c in enumerate(_LETTERS)] + [len(_LETTERS)])
_COST = 1.0 - np.eye(len(_LETTERS) + 1)
_COST[(_CLASS[:, None] == _CLASS) & (_COST > 0)] = 0.4


def stems(word: Column) -> Column:
    """`word` and what is left of it without one or two endings, three letters at least, each once."""

    def cut(words: Column) -> Column:
        one = lambda w, e: F.when(F.endswith(w, F.lit(e)) & (F.length(w) - len(e) >= 3), F.substring(w, F.lit(1), F.length(w) - len(e)))
        return F.array_distinct(F.array_compact(F.flatten(F.transform(words, lambda w: F.array(*[one(w, e) for e in ENDINGS])))))

    once = cut(F.array(word))
    return F.array_distinct(F.concat(F.array(word), once, cut(once)))


def forms(plain: Column) -> Column:
    """A simplified term with its last word's stems: structs of form and penalty."""
    words = F.split(plain, " ")
    last, head = F.element_at(words, -1), F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ")
    full = lambda w: F.when(F.size(words) > 1, F.concat(head, F.lit(" "), w)).otherwise(w)
    return F.transform(stems(last), lambda w: F.struct(full(w).alias("form"), (F.lit(PER_LETTER) * (F.length(last) - F.length(w))).alias("penalty")))


def codes(words: list[str]) -> np.ndarray:
    """Words of one length as rows of letter numbers."""
    flat = np.frombuffer("".join(words).encode("latin-1", "replace"), np.uint8).reshape(len(words), -1)
    return _CODE[np.minimum(flat, 127)]


def counts(rows: np.ndarray) -> np.ndarray:
    """How often each class of letters is in each row."""
    out = np.zeros((len(rows), len(_LETTERS) + 1), np.int16)
    for column in _CLASS[rows].T:
        out[np.arange(len(rows)), column] += 1
    return out


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row of `x` (pairs, n) to that of `y` (pairs, m): edits and swaps of neighbours cost one, confusable letters 0.4."""
    pairs, n, m = len(x), x.shape[1], y.shape[1]
    two, one = None, np.broadcast_to(np.arange(m + 1.0), (pairs, m + 1))
    for i in range(1, n + 1):
        row = np.empty((pairs, m + 1))
        row[:, 0] = i
        for j in range(1, m + 1):
            best = np.minimum(np.minimum(one[:, j], row[:, j - 1]) + 1, one[:, j - 1] + _COST[x[:, i - 1], y[:, j - 1]])
            if i > 1 and j > 1:
                crossed = (x[:, i - 1] == y[:, j - 2]) & (x[:, i - 2] == y[:, j - 1])
                best = np.where(crossed, np.minimum(best, two[:, j - 2] + 1), best)
            row[:, j] = best
        two, one = one, row
    return one[:, m]


def _near(batches):
    """Of rows (forms, limits, words): form, word and distance where it is within the form's limit."""
    for batch in batches:
        found = []
        for these, limits, words in zip(*[c.to_pylist() for c in batch.columns]):
            x, y, limits = codes(these), codes(words), np.array(limits)
            cx, cy = counts(x), counts(y)
            for lo in range(0, len(x), 64):  # a block of counts at a time
                more = cx[lo : lo + 64, None, :] - cy[None, :, :]
                least = np.maximum(np.maximum(more, 0).sum(2), np.maximum(-more, 0).sum(2))
                a, b = np.nonzero(least <= limits[lo : lo + 64, None])
                if len(a):
                    d = distances(x[lo + a], y[b])
                    ok = d <= limits[lo + a] + 1e-9
                    found += [(these[lo + i], words[j], v) for i, j, v in zip(a[ok], b[ok], d[ok].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate([pa.string(), pa.string(), pa.float64()])], ["form", "word", "distance"])


def near_words(asked: DataFrame, words: DataFrame) -> DataFrame:
    """`asked` (form, limit; not empty) and different `words` (word; not empty): form, word, distance up to the limit."""
    key = lambda c, held, n: F.pmod(F.xxhash64(c), F.greatest(F.ceil(n / held), F.lit(1)))

    def blocks(df: DataFrame, c: str, held: int, *also: str) -> DataFrame:
        """Rows of one length in blocks of about `held`: counts of lengths are a few numbers, so no rows of a length gather in a task."""
        lengths = df.groupBy(F.length(c).alias("length")).agg(F.count("*").alias("n"))  # a row for each length
        rows = df.withColumn("length", F.length(c)).join(F.broadcast(lengths), "length").withColumn("block", key(c, held, F.col("n")))
        return rows.groupBy("length", "block").agg(F.collect_list(F.struct(c, *also)).alias("rows"))

    a = blocks(asked, "form", TERMS_HELD, "limit").withColumn("reach", F.floor(F.array_max("rows.limit")).cast("int"))
    a = a.select("rows", F.explode(F.sequence(F.greatest(F.col("length") - F.col("reach"), F.lit(1)), F.col("length") + F.col("reach"))).alias("length"))
    b = blocks(words, "word", WORDS_HELD).select("length", F.col("rows.word").alias("words"))
    met = a.join(b, "length").select(F.col("rows.form").alias("forms"), F.col("rows.limit").alias("limits"), "words")
    return met.mapInArrow(_near, "form string, word string, distance double")


def corrections(terms: DataFrame, lexicon: DataFrame, protected: DataFrame, share: float = SHARE, margin: float = MARGIN) -> DataFrame:
    """`terms` (id, term) against `lexicon` (term, account; a smaller `place` goes first) and `protected` words (term): id, term, status, suggestion, distance, likeness, account, equals.

    BOS nothing to read; SAYI half digits or more: numbers are never corrected; SOZLUK_YOK the lexicon is empty; TAM the nearest
    term is this one, up to accents and endings; BILINMIYOR none is near, as with names; KORUNAN a protected word is as near;
    BELIRSIZ others are as near up to the margin (`equals`); ONERI one stands alone.
    """
    digits = F.length(F.regexp_replace("term", "[^0-9]", ""))
    blank = F.trim(F.coalesce("term", F.lit(""))) == ""
    number = (digits > 0) & (2 * digits >= F.length(F.regexp_replace("term", r"\s", "")))
    each = terms.select("id", "term", simplify("term").alias("plain"), F.when(blank, "BOS").when(number, "SAYI").alias("known"))
    plain = each.where("known is null").select("plain").distinct()
    reach = F.greatest(F.lit(share) * F.greatest(F.length("plain"), F.lit(1)), F.lit(1.0))
    asked = written(plain.select("plain", reach.alias("reach"), F.explode(forms(F.col("plain"))).alias("f")).select("plain", "reach", "f.form", "f.penalty"), "forms")
    words = written(lexicon.select("term", "account", "place", simplify("term").alias("word")).unionByName(protected.select("term", F.lit(None).cast("string").alias("account"), F.lit(-1).cast("bigint").alias("place"), simplify("term").alias("word"))), "words")
    limits = asked.where("form <> ''").groupBy("form").agg(F.max(F.col("reach") + margin - F.col("penalty")).alias("limit"))
    near = near_words(limits, words.where("word <> ''").select("word").distinct())
    met = asked.join(near, "form").withColumn("total", F.round(F.col("distance") + F.col("penalty"), 6)).where("total <= reach + %r" % (margin + 1e-9))
    met = written(met.groupBy("plain", "reach", "word").agg(F.min("total").alias("total"), F.bool_or(F.col("form") == F.col("word")).alias("same")).join(words, "word"), "near")
    own = met.where("place >= 0")
    best = own.groupBy("plain").agg(F.min(F.struct("total", "place", "term", "account", "same", "reach")).alias("b"))
    safe = met.where("place < 0").groupBy("plain").agg(F.min("total").alias("safe"))
    rivals = own.join(best, "plain").where(F.col("total") - F.col("b.total") < margin - 1e-9).groupBy("plain").agg(F.array_sort(F.collect_list(F.struct("total", "place", own["term"]))).alias("rivals"))
    found = best.join(safe, "plain", "left").join(rivals, "plain", "left")
    empty = not words.where("place is null or place >= 0").limit(1).count()  # of what is written: the lexicon is not made again
    out = each.join(found, "plain", "left")
    status = (
        F.when(F.col("known").isNotNull(), F.col("known")).when(F.lit(empty), "SOZLUK_YOK").when(F.col("b").isNull(), "BILINMIYOR").when(F.col("b.same"), "TAM").when(F.col("b.total") > F.col("b.reach"), "BILINMIYOR")
        .when(F.col("safe") <= F.col("b.total"), "KORUNAN").when(F.size("rivals") > 1, "BELIRSIZ").otherwise("ONERI")
    )
    out = out.withColumn("status", status)
    shown = F.col("status").isin("TAM", "ONERI")
    likeness = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(100 * (1 - F.col("b.total") / F.greatest(F.length("plain"), F.lit(1))) + 1e-9)))
    return out.select(
        "id", "term", "status", F.when(shown, F.col("b.term")).alias("suggestion"), F.when(F.col("status") == "ONERI", F.round("b.total", 2)).alias("distance"), F.when(F.col("status") == "ONERI", likeness).cast("int").alias("likeness"),
        F.when(F.col("status") == "ONERI", F.col("b.account")).alias("account"), F.when(F.col("status") == "BELIRSIZ", F.col("rivals.term")).alias("equals"),
    )
