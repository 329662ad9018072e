"""Integer money: amounts are whole kurus (1/100) in bigint columns named `*_kr`; nothing is rounded but where it says so."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bound(x: Column, made) -> Column:
    """`made` of `x`, where `x` is named once: an expression written out at each use would grow with the product of the uses."""
    return F.get(F.transform(F.array(x), made), F.lit(0))


def kurus(amount: str | Column) -> Column:
    """Currency units with two decimals (double or decimal) to kurus."""
    return F.round(col(amount) * 100).cast("bigint")


def div(a: str | Column, b: int | Column) -> Column:
    """Integer division that truncates toward zero."""
    return F.call_function("div", col(a).cast("bigint"), (F.lit(b) if isinstance(b, int) else b).cast("bigint"))


def percent(amount: str | Column, rate: int | str | Column) -> Column:
    """`rate` percent, truncated."""
    return div(col(amount) * (F.lit(rate) if isinstance(rate, int) else col(rate)), 100)


def percent_half_up(amount: str | Column, rate: int | str | Column) -> Column:
    return div(col(amount) * (F.lit(rate) if isinstance(rate, int) else col(rate)) + 50, 100)


def half_away(a: str | Column, b: int | Column) -> Column:
    """a / b rounded half away from zero, in 38-digit integers."""
    big = "decimal(38,0)"
    b = (F.lit(b) if isinstance(b, int) else b).cast(big)
    a = col(a).cast(big)
    return (F.signum(a).cast("int") * F.call_function("div", 2 * F.abs(a) + b, 2 * b)).cast("bigint")


def present_value(amount: str | Column, rate_ppm: int, days: int) -> Column:
    """Amount * 365 / (365 + rate * days), the rate in millionths."""
    return half_away(col(amount).cast("decimal(20,0)") * 365_000_000, 365_000_000 + rate_ppm * days)


def formatted(amount: str | Column) -> Column:
    """1.234,56"""
    a = col(amount)
    whole = F.regexp_replace(F.format_number(F.abs(div(a, 100)), 0), ",", ".")
    return F.concat(F.when(a < 0, "-").otherwise(""), whole, F.lit(","), F.lpad((F.abs(a) % 100).cast("string"), 2, "0"))


def total(x: str | Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0)).cast("bigint")
