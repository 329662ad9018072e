"""Account codes: `120`, sub-accounts `120.07`; the digits before the dot are the hierarchy class, group, ledger account."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.money import col

#: Cost accounts that work on the credit side (fixed values of the uniform chart).
REFLECTIONS = ["701", "711", "721", "731", "741", "751", "761", "771", "781", "798"]


def ledger_code(code: str | Column) -> Column:
    return F.substring_index(col(code), ".", 1)


def level(code: str | Column) -> Column:
    """Digits of an undotted code; 3 and the number of dots otherwise."""
    c = col(code)
    dots = F.length(c) - F.length(F.replace(c, F.lit("."), F.lit("")))
    return F.when(dots > 0, dots + 3).otherwise(F.length(c))


def nature(code: str | Column, name: str | Column) -> Column:
    """Debit or credit: by class, turned by a name that ends with `(-)`; reflection accounts are credit."""
    c = col(code)
    first = F.substring(c, 1, 1)
    base = F.when(first.isin("1", "2", "7", "9"), "debit").when(first.isin("3", "4", "5", "6"), "credit")
    turned = F.when(base == "debit", "credit").when(base == "credit", "debit")
    return F.when(c.isin(REFLECTIONS), "credit").otherwise(F.when(F.trim(col(name)).endswith("(-)"), turned).otherwise(base))


def kind(code: str | Column, name: str | Column) -> Column:
    first = F.substring(col(code), 1, 1)
    return (
        F.when(first.isin("1", "2"), "asset")
        .when(first.isin("3", "4", "5"), "liability")
        .when((first == "6") & (nature(code, name) == "credit"), "income")
        .when(first == "6", "expense")
        .when(first == "7", "cost")
        .when(first == "9", "memo")
    )


def ancestors(code: str | Column) -> Column:
    """All codes that the account is under, itself included: digit prefixes of the first part, then each dotted prefix."""
    c = col(code)
    parts = F.split(c, r"\.")
    digits = F.transform(F.sequence(F.lit(1), F.length(parts[0])), lambda n: F.substring(parts[0], F.lit(1), n))
    dotted = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    return F.array_distinct(F.concat(digits, dotted))


def under(code: str | Column, prefix: str) -> Column:
    """Equal, a dotted child, or its first part begins with the prefix."""
    c = col(code)
    return (c == prefix) | c.startswith(prefix + ".") | ledger_code(c).startswith(prefix)


def under_any(code: str | Column, prefix: str) -> Column:
    """As `under`, for audit programmes: `*` is every account, a prefix without a dot any code that begins with it."""
    return F.lit(True) if prefix == "*" else under(code, prefix) if "." in prefix else col(code).startswith(prefix)


def child_of(code: str | Column, parent: str) -> Column:
    """Equal or a dotted child."""
    return (col(code) == parent) | col(code).startswith(parent + ".")
