"""Expense accounts: which account a kind of expense goes to, by how a firm keeps its costs, and what of it is not deductible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.money import div, total

#: Expenses by where they arise (7A), by their kind (7B), or without cost accounts.
OPTIONS = ("7A", "7B", "yok")
#: Where a cost account is reflected to, fixed values.
REFLECTED = {"710": "151", "720": "151", "730": "151", "740": "622", "750": "630", "760": "631", "770": "632", "780": "660"}
#: The sub-account of what is not deductible, fixed value.
REFUSED = "99"


def _given(code: str) -> Column:
    return F.when(~F.col(code).isin("", "-"), F.col(code))


def chosen(option: str, targets: dict[str, str] = REFLECTED) -> Column:
    """The account or comma list of accounts, of columns `a` (7A) and `b` (7B); the other one where the option's own is missing or `-`.

    Without cost accounts an expense goes to what its 7A account is reflected to, the first of several; if there is none, to that of 7A.
    """
    by = {"7A": F.coalesce(_given("a"), _given("b")), "7B": F.coalesce(_given("b"), _given("a"))}
    if option in by:
        return by[option]
    first = F.regexp_extract("a", "^[^/ ]*", 0)
    target = F.coalesce(*[F.when(first == k, v) for k, v in targets.items()])
    return F.coalesce(target, by["7A"])


def expense_catalogue(kinds: DataFrame, sector: str, option: str, targets: dict[str, str] = REFLECTED) -> DataFrame:
    """`kinds` (kind, a, b, sectors, refused_percent or null) of a sector (`*` is any): primary account, alternatives, sub-account of what is not deductible."""
    own = kinds.where(F.array_contains("sectors", "*") | F.array_contains("sectors", sector))
    parts = F.transform(F.split(chosen(option, targets), ","), lambda x: F.trim(x))
    account = F.element_at(parts, 1)
    rest = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x != "")
    refused = F.when(F.col("refused_percent").isNotNull(), F.concat(account, F.lit("." + REFUSED)))
    return own.select("kind", account.alias("account"), rest.alias("alternatives"), refused.alias("refused_account"), "refused_percent")


def booked_expenses(expenses: DataFrame, catalogue: DataFrame) -> DataFrame:
    """`expenses` (kind, amount_kr) summed by account: what is not deductible of each expense, rounded down, on its sub-account.

    Kinds that the catalogue lacks have a null account, so that no expense is lost.
    """
    met = expenses.join(catalogue, "kind", "left")
    part = F.coalesce(div(F.col("amount_kr") * F.col("refused_percent"), 100), F.lit(0).cast("bigint"))
    met = met.groupBy("kind", "account", "refused_account").agg(F.count("*").alias("n"), total(F.col("amount_kr") - part).alias("own"), total(part).alias("refused"))
    row = lambda account, n, amount: F.struct(account.alias("account"), n.alias("n"), amount.alias("amount_kr"))
    both = met.select(F.inline(F.array(row(F.col("account"), F.col("n"), F.col("own")), row(F.col("refused_account"), F.lit(0).cast("bigint"), F.col("refused")))))
    return both.where("n > 0 or amount_kr > 0").groupBy("account").agg(total("n").alias("n"), total("amount_kr").alias("amount_kr"))
