"""Day-to-day work on the books: final vouchers, reversal guards, working papers, cards and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import accounts as A
from tallyspark.functions.money import total
from tallyspark.operators import allocation
from tallyspark.operators.posting import numbered
from tallyspark.operators.running import PART, ranged, running

#: Voucher kinds of the period's own mechanism, which need no evidence (fixed values).
SYSTEMIC = ["ACILIS", "KAPANIS"]


def finalized(heads: DataFrame, rules: DataFrame) -> DataFrame:
    """`heads` (voucher, date, series, kind, evidence) that pass their `rules` (voucher, rule), with gapless numbers, their
    voucher number `SERIES-n`, and whether evidence is missing where it is not compulsory."""
    good = heads.join(rules.where("rule = 'OK'").select("voucher"), "voucher", "left_semi")
    bare = (F.col("evidence").isNull() & ~F.col("kind").isin(SYSTEMIC)).alias("bare")
    return numbered(good, "date", "voucher").select("voucher", "date", "series", "serial", "journal_no", F.concat_ws("-", "series", F.col("serial").cast("string")).alias("voucher_no"), bare)


def chronology(vouchers: DataFrame) -> DataFrame:
    """`vouchers` (series, number, date) dated before one with a smaller number of their series, with the latest date before them."""
    out = running(ranged(vouchers, ["series"], ["number"]), ["series"], ["number"], {"latest": (F.max, F.col("date"), -1)})
    return out.where("date < latest").select("series", "number", "date", "latest")


def reversal_findings(requests: DataFrame, vouchers: DataFrame) -> DataFrame:
    """What forbids the reversal of a voucher: `requests` (voucher, date), `vouchers` (voucher, date, final, reverses).

    R01 no such voucher, R02 not final, R03 it is a reversal itself, R04 reversed already, R05 dated before it.
    """
    v = vouchers.select("voucher", F.col("date").alias("booked"), "final", "reverses")
    gone = vouchers.where("reverses is not null").select(F.col("reverses").alias("voucher")).distinct().withColumn("gone", F.lit(True))
    met = requests.join(v, "voucher", "left").join(gone, "voucher", "left")
    when = lambda c, code: F.when(c, F.lit(code))
    codes = F.array_compact(F.array(when(~F.col("final"), "R02"), when(F.col("reverses").isNotNull(), "R03"), when(F.col("gone"), "R04"), when(F.col("date") < F.col("booked"), "R05")))
    return met.select("voucher", F.explode(F.when(F.col("booked").isNull(), F.array(F.lit("R01"))).otherwise(codes)).alias("code"))


def period_ledger(journal: DataFrame, since: str, until: str) -> DataFrame:
    """Movements of a period by account, with the balance brought forward from before it and the running balance."""
    amount = F.col("debit_kr") - F.col("credit_kr")
    day = lambda x: F.lit(x).cast("date")
    before = journal.where(F.col("date") < day(since)).groupBy("account").agg(F.sum(amount).cast("bigint").alias("opening_kr"))
    order = ["date", "voucher", "line_no"]
    rows = journal.where(F.col("date").between(day(since), day(until))).select("account", *order, "debit_kr", "credit_kr")
    out = running(ranged(rows, ["account"], order), ["account"], order, {"moved_kr": (F.sum, amount)}).drop(PART)
    opening = F.coalesce("opening_kr", F.lit(0))
    return out.join(before, "account", "left").select("account", *order, "debit_kr", "credit_kr", opening.alias("opening_kr"), (opening + F.col("moved_kr")).alias("balance_kr"))


def voucher_detail(journal: DataFrame, chart: DataFrame) -> DataFrame:
    """Every line of every voucher with its account's name; the chart is of bounded size."""
    names = chart.select(F.col("code").alias("ledger"), "name")
    out = journal.withColumn("ledger", A.ledger_code("account")).join(F.broadcast(names), "ledger", "left")
    return out.select("voucher", "line_no", "date", "kind", "account", F.coalesce("name", F.lit("")).alias("name"), "debit_kr", "credit_kr")


def working_paper(journal: DataFrame, programmes: DataFrame) -> DataFrame:
    """For each programme's prefixes (`programmes`: programme, prefix) its accounts with their movements and the net of each month."""
    months = [total(F.when(F.month("date") == m, F.col("debit_kr") - F.col("credit_kr")).otherwise(0)).alias(f"m{m:02}") for m in range(1, 13)]
    sums = journal.groupBy("account").agg(F.count("*").alias("movements"), total(F.col("debit_kr") - F.col("credit_kr")).alias("net_kr"), *months)
    under = sums.select("*", F.explode(A.ancestors("account")).alias("prefix")).join(F.broadcast(programmes), "prefix")
    return under.select("programme", *sums.columns).distinct()


def health(**findings: DataFrame) -> DataFrame:
    """One row: the number of rows of each of `findings`, and whether all are empty."""
    out = None
    for name, df in findings.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("test"), "n")
        out = one if out is None else out.unionByName(one)
    counts = out.groupBy().pivot("test", list(findings)).agg(F.sum("n"))
    return counts.withColumn("sound", sum((F.col(c) for c in findings), F.lit(0)) == 0)


def allocation_lines(allocated: DataFrame, money: DataFrame, direction: str = "SATIS") -> DataFrame:
    """Two lines for each allocation: the money's account against 120 for sales; 320 against the money's account for purchases."""
    sale = direction == "SATIS"
    met = allocated.join(money.select("id", "instrument"), "id")
    own, zero, amount = allocation.money_account("instrument", F.lit(sale)), F.lit(0).cast("bigint"), F.col("amount_kr")
    first, second = (own, F.lit("120")) if sale else (F.lit("320"), own)
    line = lambda n, account, debit: F.struct(F.lit(n).alias("line_no"), account.alias("account"), (amount if debit else zero).alias("debit_kr"), (zero if debit else amount).alias("credit_kr"))
    return met.select(F.lit(direction).alias("direction"), "id", "no", F.inline(F.array(line(1, first, True), line(2, second, False))))


def waiting(unallocated: DataFrame, awaited: DataFrame, days: int = 7) -> DataFrame:
    """Money that no invoice has, by bank: receipts, sum, the oldest, how many are marked as waiting for an invoice (`awaited`: id), and of these those of
    more than `days` days, which call for a reminder."""
    marked = unallocated.join(awaited.select("id").distinct().withColumn("awaited", F.lit(True)), "id", "left").withColumn("awaited", F.coalesce("awaited", F.lit(False)))
    late = F.col("awaited") & (F.col("age_days") > days)
    return marked.groupBy("bank").agg(F.count("*").alias("n"), total("remaining_kr").alias("open_kr"), F.max("age_days").alias("oldest_days"), F.count_if("awaited").alias("awaited"), F.count_if(late).alias("reminders"))


def asset_cards(assets: DataFrame, journal: DataFrame, prefix: str) -> DataFrame:
    """`assets` (id, code, value_kr) under `prefix` (`*` for all), each with the ledger's balance of exactly its account."""
    own = assets.where(A.under_any("code", prefix))
    booked = journal.groupBy(F.col("account").alias("code")).agg(total(F.col("debit_kr") - F.col("credit_kr")).alias("booked_kr"))
    return own.join(booked, "code", "left").select("id", "code", "value_kr", F.coalesce("booked_kr", F.lit(0)).alias("booked_kr"))


def normal_code(code: str | Column) -> Column:
    """A code as it was meant: five characters or more, letters and digits, half of the letters upper case: l is I, o is O, all upper."""
    c = F.trim(F.col(code) if isinstance(code, str) else code)
    count = lambda p: F.length(F.regexp_replace(c, f"[^{p}]", ""))
    shaped = (F.length(c) >= 5) & c.rlike("^[A-Za-z0-9-]+$") & c.rlike("[A-Za-z]") & c.rlike("[0-9]") & (2 * count("A-Z") >= count("A-Za-z"))
    return F.when(shaped, F.upper(F.translate(c, "lo", "IO"))).otherwise(c)


def latest_state(events: DataFrame) -> DataFrame:
    """`events` (no, at, state) to each entry's last state; withdrawn ones are out, final ones can no longer change."""
    last = events.groupBy("no").agg(F.max(F.struct("at", "state")).alias("x"), F.bool_or(F.col("state") == "KESIN").alias("final"))
    return last.select("no", F.when(F.col("final"), "KESIN").otherwise(F.col("x.state")).alias("state"), (F.col("final") | (F.col("x.state") != "VAZGECILDI")).alias("counts"))


def receipt_lists(receipts: DataFrame, allocated: DataFrame) -> DataFrame:
    """Each receipt with the number of invoices it pays, the first and last of them, and what is left."""
    paid = allocated.groupBy("id").agg(F.count("*").alias("n"), F.min("no").alias("first_no"), F.max("no").alias("last_no"), total("amount_kr").alias("paid_kr"))
    out = receipts.join(paid, "id", "left")
    return out.select("id", "party", "date", "instrument", "amount_kr", F.coalesce("n", F.lit(0)).alias("n"), "first_no", "last_no", (F.col("amount_kr") - F.coalesce("paid_kr", F.lit(0))).alias("left_kr"))
