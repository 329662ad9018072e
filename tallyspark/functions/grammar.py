"""Stems of inflected words, as column expressions.  They multiply what a word may be; a dictionary decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.money import bound, col

#: Letters that a stem keeps at least.
SHORTEST = 3
_VOWELS = "aıoueiöü"


def lower_turkish(x: str | Column) -> Column:
    """Lower case in which İ is i and I is ı."""
    return F.lower(F.translate(col(x), "İI", "iı"))


def _harmony(body: Column) -> tuple[Column, Column]:
    """The open and the closed vowel that an ending of `body` has."""
    last = F.regexp_extract(body, rf"([{_VOWELS}])[^{_VOWELS}]*$", 1)
    return F.translate(last, "aıoueiöü", "aaaaeeee"), F.translate(last, "aıoueiöü", "ııuuiiüü")


def _hard(body: Column) -> Column:
    """`body` with the hard consonant that its softened end stands for, or null."""
    end = F.right(body, F.lit(1))
    return F.when(end.isin("b", "c", "d", "g", "ğ"), F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.translate(end, "bcdgğ", "pçtkk")))


def _without_ending(w: Column) -> Column:
    """All that one Turkish ending may have been added to: plural, possessive, accusative, cases; an ending out of harmony is none."""
    n = F.length(w)
    body = lambda k: F.substring(w, F.lit(1), n - k)
    ends = lambda *xs: F.right(w, F.lit(len(xs[0]))).isin(*xs)
    letter = lambda back: F.substring(w, n - back + 1, F.lit(1))  # noqa: E731  1 is the last
    flat, narrow = lambda k: _harmony(body(k))[0], lambda k: _harmony(body(k))[1]
    vowel = lambda x: F.right(x, F.lit(1)).rlike(f"[{_VOWELS}]")
    bare = ends("ı", "i", "u", "ü") & ~vowel(body(1)) & (narrow(1) == letter(1))
    found = [
        F.when(ends("lar", "ler") & (flat(3) == letter(2)), body(3)), F.when((n > 4) & (letter(2) == "s") & vowel(body(2)) & (narrow(2) == letter(1)), body(2)), F.when(bare, body(1)), F.when(bare, _hard(body(1))),
        F.when((n > 4) & ends("da", "de", "ta", "te") & (flat(2) == letter(1)), body(2)), F.when((n > 5) & ends("dan", "den", "tan", "ten") & (flat(3) == letter(2)), body(3)), F.when(ends("ın", "in", "un", "ün") & (narrow(2) == letter(2)), body(2)),
    ]
    return F.when(n > SHORTEST, F.filter(F.array_compact(F.array(*found)), lambda b: F.length(b) >= SHORTEST)).otherwise(F.array().cast("array<string>"))


def turkish_stems(word: str | Column) -> Column:
    """`word` in lower case and what two endings at most may have been added to, softened consonants also hard."""
    hard = lambda xs: F.flatten(F.transform(xs, lambda x: F.array_compact(F.array(x, _hard(x)))))
    twice = lambda once: F.flatten(F.transform(once, _without_ending))
    every = lambda w: bound(_without_ending(w), lambda once: F.array_distinct(F.concat(F.array(w), hard(once), hard(twice(once)))))
    return bound(lower_turkish(word), every)


def english_stems(word: str | Column) -> Column:
    """`word` in lower case, without 's, and singular as its end allows."""
    return bound(F.lower(col(word)), _english)


def _english(w: Column) -> Column:
    n = F.length(w)
    body = lambda k: F.substring(w, F.lit(1), n - k)
    owned = (F.endswith(w, F.lit("'s")) | F.endswith(w, F.lit("’s"))) & (n >= 4)
    found = [w, F.when(owned, body(2)), F.when((n > 3) & F.endswith(w, F.lit("ies")), F.concat(body(3), F.lit("y"))), F.when((n > 3) & F.endswith(w, F.lit("es")), body(2)), F.when((n > 2) & F.endswith(w, F.lit("s")) & ~F.endswith(w, F.lit("ss")), body(1))]
    return F.array_distinct(F.array_compact(F.array(*found)))


def phrase_stems(phrase: str | Column, stems=turkish_stems) -> Column:
    """A phrase with the stems of its last word, which alone is inflected in a noun phrase."""
    return bound(F.filter(F.split(F.trim(col(phrase)), r"\s+"), lambda w: w != ""), lambda words: _phrase(words, stems))


def _phrase(words: Column, stems) -> Column:
    head = F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), " ")
    found = stems(F.coalesce(F.get(words, F.size(words) - 1), F.lit("")))
    return F.transform(found, lambda s: F.when(F.size(words) > 1, F.concat(head, F.lit(" "), s)).otherwise(s))
