"""VAT, advance tax, withholding and the other calculators; all in whole kurus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.accounts import child_of
from tallyspark.functions.money import div, percent, total


def vat_offset(journal: DataFrame) -> DataFrame:
    """Credit nets of 391 accounts debited, debit nets of 191 and 190 credited, the difference to 360 or 190."""
    zero = F.lit(0).cast("bigint")
    nets = journal.where(child_of("account", "391") | child_of("account", "191") | child_of("account", "190")).groupBy("account").agg(total(F.col("debit_kr") - F.col("credit_kr")).alias("net_kr"))
    computed = F.col("account").startswith("391")
    rows = nets.where((computed & (F.col("net_kr") < 0)) | (~computed & (F.col("net_kr") > 0)))
    legs = rows.select("account", F.greatest(-F.col("net_kr"), zero).alias("debit_kr"), F.greatest("net_kr", zero).alias("credit_kr"))
    off = legs.agg(total(F.col("debit_kr") - F.col("credit_kr")).alias("off")).where("off <> 0")
    rest = off.select(F.when(F.col("off") > 0, "360").otherwise("190").alias("account"), F.greatest(-F.col("off"), zero).alias("debit_kr"), F.greatest("off", zero).alias("credit_kr"))
    return legs.unionByName(rest)


def vat_status(journal: DataFrame) -> DataFrame:
    """Computed, deductible and carried VAT, sub-accounts included."""
    of = lambda code, sign: F.greatest(total(F.when(child_of("account", code), sign * (F.col("debit_kr") - F.col("credit_kr"))).otherwise(0)), F.lit(0))
    return journal.agg(of("391", -1).alias("computed_kr"), of("191", 1).alias("deductible_kr"), of("190", 1).alias("carried_kr"))


def vat_return(journal: DataFrame) -> DataFrame:
    """A row for each month: computed and deductible VAT of its own, what is carried in, and payable or carried out.

    With c the running surplus, carry-out is the running sum less its running minimum (or less nothing above zero): the
    closed form of carrying every surplus to the next month.
    """
    own = journal.where(child_of("account", "391") | child_of("account", "191")).groupBy(F.trunc("date", "month").alias("month")).agg(
        total(F.when(F.col("account").startswith("391"), F.col("credit_kr") - F.col("debit_kr")).otherwise(0)).alias("computed_kr"),
        total(F.when(F.col("account").startswith("191"), F.col("debit_kr") - F.col("credit_kr")).otherwise(0)).alias("deductible_kr"),
    )
    w = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)  # a row a month
    run = own.withColumn("run", F.sum(F.col("deductible_kr") - F.col("computed_kr")).over(w))
    run = run.withColumn("carry_out_kr", F.col("run") - F.least(F.min("run").over(w), F.lit(0)))
    run = run.withColumn("carry_in_kr", F.coalesce(F.lag("carry_out_kr").over(Window.orderBy("month")), F.lit(0)))
    payable = F.greatest(F.col("computed_kr") - F.col("deductible_kr") - F.col("carry_in_kr"), F.lit(0))
    return run.select("month", "computed_kr", "deductible_kr", "carry_in_kr", payable.alias("payable_kr"), "carry_out_kr")


def vat_by_rate(journal: DataFrame) -> DataFrame:
    """Month, rate, VAT and the base that the rate implies."""
    rate = F.substring_index("account", ".", -1).cast("int")
    own = journal.where(F.col("account").startswith("391.")).groupBy(F.trunc("date", "month").alias("month"), rate.alias("rate")).agg(total(F.col("credit_kr") - F.col("debit_kr")).alias("vat_kr"))
    return own.where("vat_kr > 0 and rate > 0").withColumn("base_kr", div(F.col("vat_kr") * 100, F.col("rate")))


def advance_tax(journal: DataFrame, rate: int = 25) -> DataFrame:
    """For each quarter of a year: cumulative profit, tax computed on it, less what the earlier quarters had computed."""
    quarters = journal.where("account LIKE '6%' AND account NOT LIKE '69%'").groupBy(F.year("date").alias("year"), F.quarter("date").alias("quarter")).agg(total(F.col("credit_kr") - F.col("debit_kr")).alias("own_kr"))
    w = Window.partitionBy("year").orderBy("quarter")
    cumulative = quarters.withColumn("profit_kr", F.sum("own_kr").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    computed = cumulative.withColumn("computed_kr", percent(F.greatest("profit_kr", F.lit(0)), rate))
    before = F.coalesce(F.lag("computed_kr").over(w), F.lit(0))
    return computed.select("year", "quarter", "profit_kr", "computed_kr", F.greatest(F.col("computed_kr") - before, F.lit(0)).alias("payable_kr"))


def rates_as_of(rows: DataFrame, rates: DataFrame, date: str = "date") -> DataFrame:
    """`rows` with the catalogue's rates of their `rate` that hold on their date (an open end holds on); the catalogue is small."""
    r = rates.select(F.col("rate").alias("_rate"), "code", "valid_from", "valid_to")
    holds = (F.col(date) >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col(date) <= F.col("valid_to")))
    return rows.join(F.broadcast(r), (F.col("rate") == F.col("_rate")) & holds, "left").drop("_rate")


def vat_calculation(gross: bool, amount: Column, rate: Column, p: int = 0, q: int = 1) -> Column:
    """struct(net, vat, withheld, gross); from the gross, VAT is what the net leaves, so nothing leaks."""
    net = div(amount * 100, 100 + rate) if gross else amount
    vat = amount - net if gross else percent(amount, rate)
    held = div(vat * p, q) if 0 < p < q else F.lit(0).cast("bigint")
    return F.struct(net.alias("net_kr"), vat.alias("vat_kr"), held.alias("withheld_kr"), (net + vat).alias("gross_kr"))


def withholding(gross: bool, amount: Column, rate: int) -> Column:
    """struct(gross, tax, net) from a gross or a net amount."""
    whole = amount if gross else div(amount * 100, F.lit(100 - rate))
    tax = percent(whole, rate) if gross else whole - amount
    return F.struct(whole.alias("gross_kr"), tax.alias("tax_kr"), (whole - tax).alias("net_kr"))


def stamp_duty(amount: Column, per_mille: float) -> Column:
    return F.round(amount.cast("double") * per_mille / 1000).cast("bigint")


def excise(amount: Column, rate: int, fixed: Column | None, vat_rate: int) -> Column:
    """struct(excise, vat): a fixed excise overrides the rate, and excise is part of the VAT base."""
    duty = percent(amount, rate) if fixed is None else F.coalesce(fixed, percent(amount, rate))
    return F.struct(duty.alias("excise_kr"), percent(amount + duty, vat_rate).alias("vat_kr"))


def expense_split(rows: DataFrame) -> DataFrame:
    """`rows` (id, amount_kr, rule, share, limit_kr) into deductible and non-deductible parts that sum to the amount.

    Rules: TAMAMI all non-deductible, ORANSAL the share, HADDI_ASAN above the limit (unknown limit: all deductible, with
    a warning), KISMEN the share of what is above the limit, else none.
    """
    over = F.greatest(F.col("amount_kr") - F.col("limit_kr"), F.lit(0))
    non = (
        F.when(F.col("rule") == "TAMAMI", F.col("amount_kr")).when(F.col("rule") == "ORANSAL", percent("amount_kr", "share"))
        .when(F.col("limit_kr").isNull(), F.lit(0)).when(F.col("rule") == "HADDI_ASAN", over).when(F.col("rule") == "KISMEN", percent(over, "share")).otherwise(0)
    )
    out = rows.withColumn("non_kr", non.cast("bigint"))
    warning = F.col("rule").isin("HADDI_ASAN", "KISMEN") & F.col("limit_kr").isNull()
    return out.select("id", "rule", "amount_kr", (F.col("amount_kr") - F.col("non_kr")).alias("deductible_kr"), F.col("non_kr").alias("non_deductible_kr"), warning.alias("warning"))


def party_declaration(invoices: DataFrame, limit_kr: int) -> DataFrame:
    """Month, direction and party of valid invoices with net, count and whether the total reaches the declaration limit."""
    net = F.col("net_kr") - F.col("return_net_kr") - F.col("discount_net_kr")
    own = invoices.where("valid").where(net > 0).groupBy(F.trunc("date", "month").alias("month"), "direction", "party").agg(F.count("*").alias("n"), total(net).alias("net_kr"))
    return own.withColumn("declared", F.col("net_kr") >= limit_kr)
