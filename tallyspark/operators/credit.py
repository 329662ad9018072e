"""Loan schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def monthly_rates(rate_bp: Column, tranches: Column, term: Column) -> Column:
    """A monthly rate for each instalment: tranches in turn, the last goes on; without tranches the loan's own rate."""
    opened = F.flatten(F.transform(tranches, lambda t: F.array_repeat(t["annual_bp"] / 10_000 / 12, t["months"].cast("int"))))
    base = F.when(F.size(opened) > 0, opened).otherwise(F.array(rate_bp / 10_000 / 12))
    return F.slice(F.concat(base, F.array_repeat(F.element_at(base, -1), F.greatest(term - F.size(base), F.lit(0)).cast("int"))), 1, term.cast("int"))


def annuity(left: Column, rate: Column, months: Column) -> Column:
    grown = F.pow(1 + rate, months)
    return F.when(rate > 0, F.round(left * (rate * grown / (grown - 1)))).otherwise(F.ceil(left / months)).cast("bigint")


def schedule(loans: DataFrame) -> DataFrame:
    """`loans` (id, principal_kr, rate_bp, term, start, method, bsmv_bp, tranches) to instalments.

    Methods: Annuite (recomputed when the rate changes), EsitAnapara, Spot.  A fold over the months carries what is left;
    the last instalment pays the rest, so principal parts add up.
    """
    term = F.greatest("term", F.lit(1))
    rates = monthly_rates(F.col("rate_bp"), F.col("tranches"), term)
    row = "struct<no:int,principal_kr:bigint,interest_kr:bigint,left_kr:bigint>"
    df = loans.withColumn("n", term).withColumn("rates", rates)
    start = F.struct(F.col("principal_kr").cast("bigint").alias("left"), F.lit(0).cast("bigint").alias("fixed"), F.lit(-1.0).alias("rate"), F.expr(f"cast(array() as array<{row}>)").alias("rows"))

    def step(a, i):
        rate = F.get("rates", i - 1)
        last = i == F.col("n")
        interest = F.round(a["left"] * rate).cast("bigint")
        fixed = F.when(rate != a["rate"], annuity(a["left"], rate, F.col("n") - i + 1)).otherwise(a["fixed"])
        part = (
            F.when(last, a["left"]).when(F.col("method") == "Annuite", F.least(F.greatest(fixed - interest, F.lit(0)), a["left"]))
            .when(F.col("method") == "EsitAnapara", F.least(F.call_function("div", F.col("principal_kr"), F.col("n")), a["left"])).otherwise(F.lit(0))
        ).cast("bigint")
        left = a["left"] - part
        made = F.struct(i.cast("int").alias("no"), part.alias("principal_kr"), interest.alias("interest_kr"), left.alias("left_kr"))
        return F.struct(left.alias("left"), fixed.alias("fixed"), rate.alias("rate"), F.concat(a["rows"], F.array(made)).alias("rows"))

    each = df.select("id", "start", "bsmv_bp", F.inline(F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), start, step)["rows"]))
    tax = F.round(F.col("interest_kr") * F.col("bsmv_bp") / 10_000).cast("bigint")
    return each.select("id", "no", F.add_months("start", F.col("no")).alias("date"), (F.col("principal_kr") + F.col("interest_kr") + tax).alias("payment_kr"), "principal_kr", "interest_kr", tax.alias("bsmv_kr"), "left_kr")


def entries(loans: DataFrame) -> DataFrame:
    """Journal lines: drawdown (300 up to twelve months, 400 beyond) and each instalment."""
    account = F.when(F.col("term") <= 12, "300").otherwise("400")
    zero = F.lit(0).cast("bigint")
    leg = lambda a, d, c: F.struct((F.lit(a) if isinstance(a, str) else a).alias("account"), d.alias("debit_kr"), c.alias("credit_kr"))
    p = F.col("principal_kr").cast("bigint")
    draw = loans.select("id", F.lit(0).alias("no"), F.col("start").alias("date"), F.inline(F.array(leg("102", p, zero), leg(account, zero, p))))
    plan = schedule(loans).join(loans.select("id", account.alias("loan")), "id")
    paid = plan.select("id", "no", "date", F.inline(F.array(leg(F.col("loan"), F.col("principal_kr"), zero), leg("780", F.col("interest_kr"), zero), leg("780.01", F.col("bsmv_kr"), zero), leg("102", zero, F.col("payment_kr")))))
    return draw.unionByName(paid).where("debit_kr > 0 or credit_kr > 0")
