"""Reporting-standard adjustments: worksheet, carry-forward, remeasurements.  Rates are millionths; products are 38-digit integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.accounts import ledger_code
from tallyspark.functions.money import half_away, present_value, total

PPM = 1_000_000


def worksheet(balances: DataFrame, entries: DataFrame) -> DataFrame:
    """Ledger balances (account, net_kr) beside entry lines (no, kind AJE/RJE/CF, account, debit_kr, credit_kr): one union, one aggregation."""
    book = balances.select(ledger_code("account").alias("code"), F.lit("VUK").alias("kind"), "net_kr", F.lit(None).cast("string").alias("no"))
    lines = entries.select(F.col("account").alias("code"), "kind", (F.col("debit_kr") - F.col("credit_kr")).alias("net_kr"), "no")
    of = lambda k: total(F.when(F.col("kind") == k, F.col("net_kr")).otherwise(0)).alias(k.lower())
    out = book.unionByName(lines).groupBy("code").agg(*[of(k) for k in ("VUK", "AJE", "RJE", "CF")], F.array_join(F.array_sort(F.collect_set("no")), ",").alias("refs"))
    out = out.withColumn("adjusted", F.col("vuk") + F.col("aje")).withColumn("tfrs", F.col("adjusted") + F.col("rje") + F.col("cf"))
    return out.where("vuk <> 0 or aje <> 0 or rje <> 0 or cf <> 0")


def carried(entries: DataFrame) -> DataFrame:
    """Entry lines in the next period: profit and loss legs (6, 7) go to 570, others stay; TASIMA_YOK and YENIDEN_URET are left out, TERS_CEVIR is reversed."""
    turn = F.col("carry") == "TERS_CEVIR"
    account = F.when((F.col("carry") == "TASI_BIRAK") & F.substring("account", 1, 1).isin("6", "7"), "570").otherwise(F.col("account"))
    kept = entries.where(~F.col("carry").isin("TASIMA_YOK", "YENIDEN_URET"))
    return kept.select("no", F.lit("CF").alias("kind"), account.alias("account"), F.when(turn, F.col("credit_kr")).otherwise(F.col("debit_kr")).alias("debit_kr"), F.when(turn, F.col("debit_kr")).otherwise(F.col("credit_kr")).alias("credit_kr"))


def reclassified(balances: DataFrame, due_kr: int) -> DataFrame:
    """The part of 400 that is due within a year, to 303.90."""
    loan = balances.where("account LIKE '400%'").agg(F.greatest(-total("net_kr"), F.lit(0)).alias("loan"))
    amount = F.least(F.col("loan"), F.lit(due_kr)).cast("bigint")
    return loan.select(amount.alias("amount_kr")).where("amount_kr > 0").select(F.inline(F.array(
        F.struct(F.lit("400").alias("account"), F.col("amount_kr").alias("debit_kr"), F.lit(0).cast("bigint").alias("credit_kr")), F.struct(F.lit("303.90"), F.lit(0).cast("bigint"), F.col("amount_kr")))))


def rediscount(balances: DataFrame, rate_ppm: int = 397_500, days: int = 60, least_kr: int = 1_000_000) -> DataFrame:
    """What receivables (12 but 122, 128, 129) and payables (32 but 322) from `least_kr` on lose by discounting."""
    code = F.substring("account", 1, 3)
    side = F.when(F.col("account").startswith("12") & ~code.isin("122", "128", "129"), "receivable").when(F.col("account").startswith("32") & (code != "322"), "payable")
    amount = F.when(side == "receivable", F.col("net_kr")).otherwise(-F.col("net_kr"))
    own = balances.select("account", side.alias("side"), amount.alias("amount_kr")).where(F.col("side").isNotNull() & (F.col("amount_kr") >= least_kr))
    return own.withColumn("discount_kr", F.col("amount_kr") - present_value("amount_kr", rate_ppm, days))


def expected_loss(balances: DataFrame, buckets: tuple[int, ...] = (500_000, 250_000, 120_000, 80_000, 50_000), rates: tuple[int, ...] = (5_000, 20_000, 60_000, 150_000, 400_000), factor: int = 1_050_000) -> DataFrame:
    """Provision of each bucket of 120 and 121; the last takes what rounding leaves."""
    net = lambda p: F.greatest(total(F.when(F.col("account").startswith(p), F.col("net_kr")).otherwise(0)), F.lit(0))
    gross = balances.agg((net("120") + net("121")).alias("gross"))
    parts = [half_away(F.col("gross").cast("decimal(20,0)") * b, PPM) for b in buckets[:-1]]
    parts.append(F.col("gross") - sum(parts[1:], parts[0]))
    loss = [half_away(p.cast("decimal(20,0)") * F.lit(r * factor).cast("decimal(18,0)"), PPM * PPM) for p, r in zip(parts, rates)]
    return gross.select(F.inline(F.array(*[F.struct(F.lit(i).alias("bucket"), p.cast("bigint").alias("amount_kr"), x.alias("loss_kr")) for i, (p, x) in enumerate(zip(parts, loss), 1)])))


def compound_ppm(rate_ppm: int, years: int) -> int:
    """Discount factor in millionths, rounded each year."""
    c = PPM
    for _ in range(years):
        c = (2 * c * PPM + PPM + rate_ppm) // (2 * (PPM + rate_ppm))
    return c


def severance(rows: DataFrame, ceiling_kr: int = 7_372_987, rate_ppm: int = 35_000, years: int = 10, vesting: int = 950_000, short: int = 100_000) -> DataFrame:
    """`rows` (id, heads, wage_kr, tenths of service years, booked_kr): obligation, difference to the books, short and long parts."""
    earned = half_away(F.col("heads") * F.least(F.col("wage_kr"), F.lit(ceiling_kr)).cast("decimal(20,0)") * F.col("tenths"), 10)
    provision = half_away(earned.cast("decimal(18,0)") * F.lit(vesting * compound_ppm(rate_ppm, years)).cast("decimal(18,0)"), PPM * PPM)
    out = rows.select("id", earned.alias("earned_kr"), provision.alias("provision_kr"), (provision - F.col("booked_kr")).alias("difference_kr"))
    part = half_away(F.greatest("difference_kr", F.lit(0)).cast("decimal(20,0)") * short, PPM)
    return out.withColumn("short_kr", part).withColumn("long_kr", F.greatest("difference_kr", F.lit(0)) - part)


def realisable(balances: DataFrame, value_ppm: int = 960_000, cost_ppm: int = 50_000) -> DataFrame:
    """Inventory accounts (15 but 158, 159) below cost at their net realisable value, account by account."""
    own = balances.where("account LIKE '15%' AND account NOT LIKE '158%' AND account NOT LIKE '159%' AND net_kr > 0")
    value = half_away(F.col("net_kr").cast("decimal(20,0)") * F.lit(value_ppm * (PPM - cost_ppm)).cast("decimal(18,0)"), PPM * PPM)
    return own.select("account", "net_kr", value.alias("value_kr"), F.greatest(F.col("net_kr") - value, F.lit(0)).alias("impairment_kr"))


def scenario(rows: DataFrame, tax_ppm: int = 250_000) -> DataFrame:
    """`rows` (id, amount_kr, gain): the adjustment's two legs and its deferred tax, on the asset or the liability side."""
    zero = F.lit(0).cast("bigint")
    tax = F.call_function("div", F.col("amount_kr") * tax_ppm + 500_000, F.lit(PPM)).cast("bigint")
    leg = lambda a, d, c: F.struct(F.lit(a).alias("account"), d.alias("debit_kr"), c.alias("credit_kr"))
    amount = F.col("amount_kr")
    gain = F.array(leg("252", amount, zero), leg("522.90", zero, amount), leg("522.90", tax, zero), leg("484", zero, tax))
    loss = F.array(leg("654.90", amount, zero), leg("252", zero, amount), leg("284", tax, zero), leg("691", zero, tax))
    return rows.select("id", F.inline(F.when(F.col("gain"), gain).otherwise(loss)))


def validated(entries: DataFrame, known: DataFrame) -> DataFrame:
    """First failing rule of each entry: U1 fewer than two lines, U2 a line without exactly one side, U3 unbalanced, U4 unknown account, U5 RJE on 6 or 7, U6 the same lines as an earlier entry."""
    met = entries.join(known.select(F.col("code").alias("account"), F.lit(True).alias("known")), "account", "left")
    e = met.groupBy("no").agg(
        F.count("*").alias("n"), F.bool_or((F.col("debit_kr") > 0) == (F.col("credit_kr") > 0)).alias("side"), F.sum(F.col("debit_kr") - F.col("credit_kr")).alias("off"), F.bool_or(F.col("known").isNull()).alias("unknown"),
        F.bool_or((F.col("kind") == "RJE") & F.substring("account", 1, 1).isin("6", "7")).alias("touch"), F.sort_array(F.collect_list(F.struct("account", "debit_kr", "credit_kr"))).alias("lines"),
    )
    e = e.join(e.groupBy("lines").agg(F.min("no").alias("earliest")), "lines")  # combined before the shuffle: however many entries are alike
    again = F.col("no") > F.col("earliest")
    rule = F.when(F.col("n") < 2, "U1").when(F.col("side"), "U2").when(F.col("off") != 0, "U3").when(F.col("unknown"), "U4").when(F.col("touch"), "U5").when(F.col("again"), "U6").otherwise("OK")
    return e.withColumn("again", again).select("no", rule.alias("rule"))
