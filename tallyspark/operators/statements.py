"""Financial statements, ratios, closing entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.accounts import ledger_code
from tallyspark.functions.money import percent, total


def net_of(*prefixes: str) -> Column:
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.col("account").startswith(p)
    return F.coalesce(F.sum(F.when(hit, F.col("debit_kr") - F.col("credit_kr"))), F.lit(0)).cast("bigint")


def figures() -> list[Column]:
    """The sums that all statements need, in one aggregation."""
    names = {"gross_sales": -net_of("60"), "deductions": net_of("61"), "cogs": net_of("62"), "operating": net_of("63"), "other_income": -net_of("64"), "other_expense": net_of("65"),
             "financing": net_of("66"), "extra_income": -net_of("67"), "extra_expense": net_of("68"), "tax": net_of("691"), "current_assets": net_of("1"), "fixed_assets": net_of("2"),
             "short_liabilities": -net_of("3"), "long_liabilities": -net_of("4"), "equity": -net_of("5"), "inventory": net_of("15"), "liquid": net_of("10", "11"), "receivables": net_of("12")}
    return [c.alias(k) for k, c in names.items()]


def derived(sums: DataFrame) -> DataFrame:
    """`figures` with the subtotals of the income statement and the balance sheet."""
    c = F.col
    steps = {
        "net_sales": c("gross_sales") - c("deductions"), "gross_profit": c("net_sales") - c("cogs"), "operating_profit": c("gross_profit") - c("operating"),
        "ordinary_profit": c("operating_profit") + c("other_income") - c("other_expense") - c("financing"), "profit": c("ordinary_profit") + c("extra_income") - c("extra_expense"),
        "net_profit": c("profit") - c("tax"), "assets": c("current_assets") + c("fixed_assets"), "liabilities": c("short_liabilities") + c("long_liabilities") + c("equity") + c("net_profit"),
    }
    for name, value in steps.items():
        sums = sums.withColumn(name, value)
    return sums


INCOME = ["gross_sales", "deductions", "net_sales", "cogs", "gross_profit", "operating", "operating_profit", "other_income", "other_expense", "financing", "ordinary_profit", "extra_income", "extra_expense", "profit", "tax", "net_profit"]
BALANCE = ["current_assets", "fixed_assets", "short_liabilities", "long_liabilities", "equity", "net_profit", "assets", "liabilities"]


def statement(journal: DataFrame) -> DataFrame:
    return derived(journal.agg(*figures()))


def period_result(journal: DataFrame) -> DataFrame:
    """Class 6 without group 69."""
    own = journal.where("account LIKE '6%' AND account NOT LIKE '69%'")
    return own.agg(total(F.col("credit_kr") - F.col("debit_kr")).alias("result_kr"))


def account_balance_sheet(journal: DataFrame) -> DataFrame:
    """Ledger accounts of classes 1 to 5 with a balance, credit sides positive, and the result."""
    sums = journal.where("account < '6'").groupBy(ledger_code("account").alias("code")).agg(total(F.col("debit_kr") - F.col("credit_kr")).alias("net_kr")).where("net_kr <> 0")
    asset = F.col("code") < "3"
    rows = sums.select("code", F.when(asset, "assets").otherwise("liabilities").alias("side"), F.when(asset, F.col("net_kr")).otherwise(-F.col("net_kr")).alias("balance_kr"))
    result = journal.where("account LIKE '6%' AND (account NOT LIKE '69%' OR account LIKE '691%')").agg(total(F.col("credit_kr") - F.col("debit_kr")).alias("balance_kr")).where("balance_kr <> 0")
    return rows.unionByName(result.select(F.lit("-").alias("code"), F.lit("liabilities").alias("side"), "balance_kr"))


def closing(journal: DataFrame, tax_kr: Column | None = None) -> DataFrame:
    """The closing vouchers' lines: 1 income accounts to 690, 2 tax (691 against 370, only of a profit), 3 690 to 692, 4 692 to 590 or 591.

    `tax_kr` is an expression over `result_kr`; it is clamped to the profit.
    """
    own = journal.where("account LIKE '6%' AND account NOT LIKE '69%'").groupBy("account").agg(total(F.col("debit_kr") - F.col("credit_kr")).alias("net_kr")).where("net_kr <> 0")
    zero = F.lit(0).cast("bigint")
    mirror = own.select(F.lit(1).alias("step"), "account", F.greatest(-F.col("net_kr"), zero).alias("debit_kr"), F.greatest("net_kr", zero).alias("credit_kr"))
    result = own.agg(total(-F.col("net_kr")).alias("result_kr"))
    tax = F.lit(0) if tax_kr is None else tax_kr
    result = result.withColumn("tax_kr", F.when(F.col("result_kr") > 0, F.least(F.greatest(tax, F.lit(0)), F.col("result_kr"))).otherwise(0).cast("bigint"))
    result = result.withColumn("after_kr", F.col("result_kr") - F.col("tax_kr"))
    side = lambda step, account, amount: F.struct(F.lit(step).alias("step"), (F.lit(account) if isinstance(account, str) else account).alias("account"), F.greatest(amount, zero).alias("debit_kr"), F.greatest(-amount, zero).alias("credit_kr"))
    r, t, n = F.col("result_kr"), F.col("tax_kr"), F.col("after_kr")
    legs = F.array(side(1, "690", -r), side(2, "691", t), side(2, "370", -t), side(3, "690", r), side(3, "691", -t), side(3, "692", -n), side(4, "692", n), side(4, F.when(n >= 0, "590").otherwise("591"), -n))
    return mirror.unionByName(result.select(F.inline(legs)).where("debit_kr > 0 or credit_kr > 0"))


def balance_entry(journal: DataFrame, opening: bool) -> DataFrame:
    """Classes 1 to 5: their balances as an opening voucher, or mirrored as the closing one."""
    sums = journal.where("account < '6'").groupBy("account").agg(total(F.col("debit_kr") - F.col("credit_kr")).alias("net_kr")).where("net_kr <> 0")
    off = F.col("net_kr") if opening else -F.col("net_kr")
    return sums.select("account", F.greatest(off, F.lit(0)).alias("debit_kr"), F.greatest(-off, F.lit(0)).alias("credit_kr"))


#: name, group, value, good from, fair from, larger is better (fixed thresholds).  Denominators are 1 at least.
RATIOS = [
    ("current", "liquidity", "current_assets / greatest(short_liabilities, 1)", 2.0, 1.0, True), ("quick", "liquidity", "(current_assets - inventory) / greatest(short_liabilities, 1)", 1.0, 0.5, True),
    ("cash", "liquidity", "liquid / greatest(short_liabilities, 1)", 0.2, 0.1, True), ("leverage", "structure", "(short_liabilities + long_liabilities) / greatest(assets, 1)", 0.5, 0.7, False),
    ("debt_to_equity", "structure", "(short_liabilities + long_liabilities) / greatest(equity + net_profit, 1)", 1.0, 2.0, False), ("equity_share", "structure", "100.0 * greatest(equity + net_profit, 1) / greatest(assets, 1)", 50.0, 30.0, True),
    ("collection_days", "turnover", "CASE WHEN receivables > 0 THEN 365.0 * receivables / greatest(net_sales, 1) ELSE 0.0 END", 45.0, 90.0, False),
    ("inventory_days", "turnover", "CASE WHEN inventory > 0 AND cogs > 0 THEN 365.0 * inventory / cogs ELSE 0.0 END", 60.0, 120.0, False), ("gross_margin", "profitability", "100.0 * gross_profit / greatest(net_sales, 1)", 30.0, 15.0, True),
    ("operating_margin", "profitability", "100.0 * operating_profit / greatest(net_sales, 1)", 15.0, 5.0, True), ("net_margin", "profitability", "100.0 * net_profit / greatest(net_sales, 1)", 10.0, 3.0, True),
    ("return_on_assets", "profitability", "100.0 * net_profit / greatest(assets, 1)", 10.0, 4.0, True), ("return_on_equity", "profitability", "100.0 * net_profit / greatest(equity + net_profit, 1)", 20.0, 8.0, True),
    ("cogs_share", "profitability", "100.0 * cogs / greatest(net_sales, 1)", 70.0, 85.0, False),
]


def ratios(figures: DataFrame, *keys: str) -> DataFrame:
    """A row for each ratio of each row of `figures` (as `statement` makes them), rated good, fair or poor."""
    each = [F.struct(F.lit(n).alias("ratio"), F.lit(g).alias("grp"), F.expr(_doubles(v)).alias("value"), F.lit(a).alias("good"), F.lit(b).alias("fair"), F.lit(up).alias("up")) for n, g, v, a, b, up in RATIOS]
    out = figures.select(*keys, F.inline(F.array(*each)))
    rank = lambda edge: F.when(F.col("up"), F.col("value") >= F.col(edge)).otherwise(F.col("value") <= F.col(edge))
    return out.select(*keys, "grp", "ratio", F.round("value", 6).alias("value"), F.when(rank("good"), "good").when(rank("fair"), "fair").otherwise("poor").alias("status"))


def _doubles(sql: str) -> str:
    return sql.replace("365.0 *", "365.0D *").replace("100.0 *", "100.0D *").replace("0.0 END", "0.0D END")


def vertical(figures: DataFrame) -> DataFrame:
    """Each item's share of total assets, or of net sales."""
    share = lambda items, base: [F.struct(F.lit(i).alias("item"), F.lit(base).alias("base"), F.col(i).alias("amount_kr"), F.round(100.0 * F.col(i) / F.greatest(F.col(base), F.lit(1)), 6).alias("share")) for i in items]
    return figures.select(F.inline(F.array(*share(["current_assets", "fixed_assets", "short_liabilities", "long_liabilities", "equity"], "assets"), *share(["cogs", "gross_profit", "operating_profit", "net_profit"], "net_sales"))))


def monthly(journal: DataFrame) -> DataFrame:
    """For each month its own sales and profit, and balance figures at its end: one aggregation, then running sums."""
    by = journal.groupBy(F.trunc("date", "month").alias("month")).agg(*figures())
    w = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)  # a row a month
    stock = ["current_assets", "fixed_assets", "short_liabilities", "long_liabilities", "equity", "inventory", "liquid", "receivables"]
    out = derived(by)
    return out.select("month", *[c for c in out.columns if c not in ("month", *stock, "assets", "liabilities")], *[F.sum(c).over(w).cast("bigint").alias(c) for c in [*stock, "assets"]])


def compared(ratios: DataFrame, now: str, before: str) -> DataFrame:
    """Five ratios of two periods: flat within one percent, else better or worse."""
    names = {"current": True, "leverage": False, "gross_margin": True, "net_margin": True, "collection_days": False}
    own = ratios.where(F.col("ratio").isin(*names))
    a = own.where(F.col("period") == now).select("ratio", F.col("value").alias("now"))
    b = own.where(F.col("period") == before).select("ratio", F.col("value").alias("before"))
    met = a.join(b, "ratio").where(F.abs("before") >= 0.0001)
    up = F.col("ratio").isin(*[k for k, v in names.items() if v])
    trend = F.when(F.abs((F.col("now") - F.col("before")) / F.col("before")) < 0.01, "flat").when((F.col("now") > F.col("before")) == up, "better").otherwise("worse")
    return met.withColumn("trend", trend)


def presentation(balances: DataFrame, lines: DataFrame) -> DataFrame:
    """Balances (account, net_kr) under presentation lines (line, prefix); an account that two lines claim is ambiguous."""
    from tallyspark.functions.accounts import ancestors

    each = balances.select("account", "net_kr", F.explode(ancestors("account")).alias("prefix")).join(F.broadcast(lines), "prefix")
    claims = each.groupBy("account").agg(F.countDistinct("line").alias("claims"))
    return each.join(claims, "account").groupBy("line").agg(total("net_kr").alias("net_kr"), F.count_if(F.col("claims") > 1).alias("ambiguous"))


def estimated_tax(rate: int = 25) -> Column:
    return percent("result_kr", rate)
