"""Names and texts: folding, canonical names, word similarity, amounts written out in several notations."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions import arrays
from tallyspark.functions.money import col

_FROM = "abcdefghijklmnopqrstuvwxyzçğıöşüâûîÇĞİÖŞÜÂÛÎ"
_TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZCGIOSUAUICGIOSUAUI"
#: Courtesy titles and words of payment notes (fixed values).
TITLES = ["DR", "PROF", "MR", "MRS", "SAYIN", "BAY", "BAYAN"]
PAYMENT = ["FAST", "ANLIK", "ODEME", "HAVALE", "EFT", "TRANSFER", "GONDERILEN", "ALINAN"]


def fold(x: str | Column) -> Column:
    """Upper case without Turkish marks, independent of any locale."""
    return F.translate(col(x), _FROM, _TO)


def words(x: str | Column) -> Column:
    """Parts between blanks, full stops and commas that hold a letter or a digit."""
    return F.filter(F.split(fold(x), r"[\s.,]+"), lambda w: w.rlike(r"[\p{L}\p{N}]"))


def canonical(x: str | Column) -> Column:
    """Folded words without titles.

    What follows the first dash (hyphen, en or em dash, with or without blanks) goes if it begins with a payment word; but
    not if that leaves fewer than two words of a name that has more.
    """
    folded = fold(x)
    tail = F.regexp_extract(folded, r"(?s)^[^-–—]*[-–—][-–— ]*(.*)$", 1)
    noted = tail.rlike("^(" + "|".join(PAYMENT) + ")")
    plain = lambda t: F.filter(words(t), lambda w: ~w.isin(TITLES))
    cut, whole = plain(F.regexp_extract(folded, r"(?s)^([^-–—]*)", 1)), plain(folded)
    many = F.size(F.filter(F.split(folded, r"\s+"), lambda w: w != "")) >= 2
    return F.array_join(F.when(noted & ~((F.size(cut) < 2) & many), cut).otherwise(whole), " ")


def similarity(a: str | Column, b: str | Column) -> Column:
    """Shared words to all words of two canonical names; 0 if either is empty."""
    x, y = F.array_distinct(F.filter(F.split(col(a), " "), lambda w: w != "")), F.array_distinct(F.filter(F.split(col(b), " "), lambda w: w != ""))
    score = F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(score)


_MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿšžğışß"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyszgiss"


def simplify(x: str | Column) -> Column:
    """Lower case without accents; anything but letters and digits becomes one blank."""
    return F.trim(F.regexp_replace(F.translate(F.lower(F.translate(col(x), "İ", "i")), _MARKED, _PLAIN), "[^a-z0-9]+", " "))


_FOLDED = str.maketrans("İ" + _MARKED, "i" + _PLAIN)


def plain(texts: pa.Array) -> pa.Array:
    """`simplify` of an Arrow array."""
    if not pc.all(pc.string_is_ascii(texts), min_count=0).as_py():
        texts = pa.array([t and t.replace("İ", "i").lower().translate(_FOLDED) for t in texts.to_pylist()], pa.string())
    return arrays.said(texts)


def parse_amount(x: str | Column, decimal: str) -> Column:
    """`1.234,56` or `1,234.56` to kurus by the decimal separator; blanks and the other separator group thousands; else null."""
    other = "." if decimal == "," else ","
    plain = F.replace(F.regexp_replace(col(x), r"[\s ]", ""), F.lit(other), F.lit(""))
    shaped = F.regexp_extract(plain, rf"^-?\d+(?:\{decimal}\d{{1,2}})?$", 0)
    number = F.replace(shaped, F.lit(decimal), F.lit("."))
    return F.when(shaped != "", F.round(number.try_cast("decimal(20,2)") * 100).cast("bigint"))
