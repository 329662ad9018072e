"""Audit tests over the journal and its documents; each returns its findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import accounts as A
from tallyspark.functions.money import total
from tallyspark.operators.ledger import kinds
from tallyspark.operators.running import ranged, running
from tallyspark.sources.scratch import written


def contrary_nature(journal: DataFrame, chart: DataFrame) -> DataFrame:
    """Accounts whose balance is on the side that their nature excludes, rated by what is at stake."""
    nets = journal.groupBy("account").agg(total(F.col("debit_kr") - F.col("credit_kr")).alias("net_kr")).withColumn("code", A.ledger_code("account"))
    met = nets.join(F.broadcast(chart.select("code", A.nature("code", "name").alias("nature"))), "code")
    bad = met.where("(nature = 'debit' and net_kr < 0) or (nature = 'credit' and net_kr > 0)")
    severity = F.when(F.col("code").isin("100", "102", "153"), "high").when(F.col("code").isin("120", "320", "191", "391"), "mid").otherwise("low")
    return bad.select("account", "nature", "net_kr", severity.alias("severity"))


def monthly_deviation(journal: DataFrame, prefix: str, threshold: float = 15.0) -> DataFrame:
    """Months whose sum of line amounts is off the mean of all months with movements by more than `threshold` percent; three months at least."""
    by = journal.where(A.under_any("account", prefix)).groupBy(F.trunc("date", "month").alias("month")).agg(total(F.abs(F.col("debit_kr") - F.col("credit_kr"))).alias("amount_kr")).where("amount_kr <> 0")
    mean = by.agg(F.avg("amount_kr").alias("mean"), F.count("*").alias("n")).where("n >= 3")
    off = F.round(100 * (F.col("amount_kr") - F.col("mean")) / F.col("mean"), 6)
    return by.join(F.broadcast(mean)).withColumn("deviation", off).where(F.abs("deviation") > threshold).select("month", "amount_kr", "deviation")


def ageing(open_items: DataFrame, as_of: str, edges: tuple[int, ...] = (30, 90, 180, 365)) -> DataFrame:
    """Open amounts of each party by age in days."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col("date"))
    names = [f"upto_{e}" for e in edges] + ["older"]
    low = [None, *edges]
    each = []
    for i, n in enumerate(names):
        hit = (age > low[i] if low[i] is not None else F.lit(True)) & (age <= edges[i] if i < len(edges) else F.lit(True))
        each.append(total(F.when(hit, F.col("open_kr")).otherwise(0)).alias(n))
    return open_items.where("open_kr > 0").groupBy("party").agg(*each, total("open_kr").alias("total_kr"))


def benford(amounts: DataFrame, least_kr: int = 100) -> DataFrame:
    """Observed and expected shares of first digits, and each digit's part of chi-squared."""
    digit = F.substring(F.col("amount_kr").cast("string"), 1, 1).cast("int")
    counts = amounts.where(F.col("amount_kr") >= least_kr).groupBy(digit.alias("digit")).agg(F.count("*").alias("n"))
    all_of = counts.agg(F.sum("n").alias("total"))
    expected = F.log10(1 + 1 / F.col("digit"))
    out = counts.join(F.broadcast(all_of)).withColumn("share", F.round(F.col("n") / F.col("total"), 6)).withColumn("expected", F.round(expected, 6))
    part = F.pow(F.col("n") - F.col("total") * expected, 2) / (F.col("total") * expected)
    return out.select("digit", "n", "share", "expected", F.round(part, 4).alias("chi2"))


def near_duplicates(invoices: DataFrame, days: int = 7) -> DataFrame:
    """Invoices of a party with the same amount as the one before, at most `days` earlier."""
    w = Window.partitionBy("party", "gross_kr").orderBy("date", "no")
    out = invoices.where("gross_kr > 0").withColumn("before", F.lag("no").over(w)).withColumn("days", F.datediff("date", F.lag("date").over(w)))
    return out.where(F.col("days") <= days).select("no", "before", "party", "gross_kr", "days")


def time_pattern(events: DataFrame) -> DataFrame:
    """Each user's share of entries at night (22 to 6) and on weekends."""
    night = (F.hour("ts") >= 22) | (F.hour("ts") < 6)
    weekend = F.dayofweek("ts").isin(1, 7)
    return events.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(night).alias("night"), F.count_if(weekend).alias("weekend")).withColumn("share", F.round((F.col("night") + F.col("weekend")) / F.col("n"), 6))


def round_amounts(journal: DataFrame, multiple_kr: int, least_kr: int) -> DataFrame:
    amount = F.greatest("debit_kr", "credit_kr")
    return journal.where((amount >= least_kr) & (amount % multiple_kr == 0)).select("voucher", "line_no", "account", amount.alias("amount_kr"))


def unexpected_contra(journal: DataFrame, rules: DataFrame) -> DataFrame:
    """Pairs of ledger accounts on opposite sides of a voucher that `rules` (code, contra) do not expect, for accounts with rules.

    Sides of one voucher of each kind meet, reduced to distinct ledger accounts, so that neither many vouchers nor long ones multiply.
    """
    sides = written(kinds(journal.where("voucher is not null")), "sides")
    other = sides.select("voucher", F.col("code").alias("contra"), (~F.col("debit")).alias("debit"))
    pairs = sides.join(other, ["voucher", "debit"]).select("voucher", "code", "contra", "vouchers").distinct().groupBy("code", "contra").agg(F.sum("vouchers").alias("vouchers"))
    ruled = pairs.join(F.broadcast(rules.select("code").distinct()), "code", "left_semi")
    return ruled.join(F.broadcast(rules), ["code", "contra"], "left_anti")


def cut_off(invoices: DataFrame, period_end: str, days: int = 5) -> DataFrame:
    """Invoices within `days` of the period's end, with a return of theirs if any."""
    off = F.datediff("date", F.lit(period_end).cast("date"))
    return invoices.where(F.abs(off) <= days).select("no", "party", off.alias("offset_days"), "gross_kr", (F.col("return_net_kr") > 0).alias("returned"))


def concentration(invoices: DataFrame, percent: int) -> DataFrame:
    """Parties with `percent` per mille or more of all net sales."""
    by = invoices.where("valid").groupBy("party").agg(total("net_kr").alias("net_kr"))
    return by.join(F.broadcast(by.agg(F.sum("net_kr").alias("total_kr")))).where(1000 * F.col("net_kr") >= percent * F.col("total_kr")).select("party", "net_kr", F.round(1000 * F.col("net_kr") / F.col("total_kr"), 6).alias("per_mille"))


def chain_equality(journal: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """Whether movements of the `left` accounts' debits equal those of the `right` accounts' credits."""
    hit = lambda ps: F.substring("account", 1, 3).isin(ps)
    sums = journal.agg(total(F.when(hit(left), F.col("debit_kr")).otherwise(0)).alias("left_kr"), total(F.when(hit(right), F.col("credit_kr")).otherwise(0)).alias("right_kr"))
    return sums.withColumn("difference_kr", F.col("left_kr") - F.col("right_kr"))


def sequence_gaps(numbers: DataFrame) -> DataFrame:
    """`numbers` (series, number, date): numbers that do not follow the one before, or are dated earlier; a series may hold all rows."""
    last = {"last": (F.max, F.struct("number", "date"), -1)}
    out = running(ranged(numbers, ["series"], ["number"]), ["series"], ["number"], last)
    return out.where("number - last.number <> 1 or date < last.date").select("series", "number", F.col("last.number").alias("before"), (F.col("date") < F.col("last.date")).alias("back_dated"))


def cash_book(money: DataFrame, opening_kr: int = 25_000_000, limit_kr: int = 700_000) -> DataFrame:
    """Cash of `money` (id, direction, date, amount_kr, instrument) by date and id, with what banks pay in before the first movement of a
    month (what leaves the box in it; such a row has no id), the running balance, and what exceeds the limit for cash or leaves less than nothing.
    """
    own = money.where("instrument = 'NAKIT'").select("id", F.col("direction").alias("source"), "date", "amount_kr", F.lit(1).alias("rank"))
    fed = cash_transfers(money).select(F.lit(None).cast("bigint").alias("id"), F.lit("VIRMAN").alias("source"), "date", "amount_kr", F.lit(0).alias("rank"))
    rows = own.unionByName(fed).withColumn("book", F.lit(1)).withColumn("signed", F.when(F.col("source") == "ALIS", -F.col("amount_kr")).otherwise(F.col("amount_kr")))
    order = ["date", "rank", "id", "source"]  # a box is one key, so it is read in ranges
    out = running(ranged(rows, ["book"], order), ["book"], order, {"until": (F.sum, F.col("signed"))}).withColumn("balance_kr", (F.lit(opening_kr) + F.col("until")).cast("bigint"))
    over = (F.col("source") != "VIRMAN") & (F.col("amount_kr") > limit_kr)
    return out.select("id", "source", "date", "amount_kr", "balance_kr", over.alias("over_limit"), (F.col("balance_kr") < 0).alias("negative"))


def cash_findings(book: DataFrame, opening_kr: int = 25_000_000) -> DataFrame:
    """One row over a cash book: movements, those over the limit and their sum, those that leave less than nothing, transfers, closing balance."""
    signed = F.when(F.col("source") == "ALIS", -F.col("amount_kr")).otherwise(F.col("amount_kr"))
    return book.agg(
        F.count("*").alias("n"), F.count_if("over_limit").alias("over_n"), total(F.when(F.col("over_limit"), F.col("amount_kr")).otherwise(0)).alias("over_kr"), F.count_if("negative").alias("negative_n"),
        total(F.when(F.col("source") == "VIRMAN", F.col("amount_kr")).otherwise(0)).alias("transfers_kr"), (F.lit(opening_kr) + total(signed)).alias("closing_kr"),
    )


def cash_transfers(money: DataFrame) -> DataFrame:
    """What banks pay into the cash box: what leaves it in a month (cash of any direction but sales), as one transfer on the month's first day."""
    own = money.where("instrument = 'NAKIT' and direction <> 'SATIS'")
    return own.groupBy(F.trunc("date", "month").alias("date")).agg(F.count("*").alias("n"), total("amount_kr").alias("amount_kr"))


def bank_book(movements: DataFrame, opening_kr: int = 500_000_000) -> DataFrame:
    from tallyspark.operators.reconcile import signed

    out = running(ranged(movements, ["account"], ["seq"]), ["account"], ["seq"], {"running_kr": (F.sum, signed())})
    return out.select("account", "seq", "date", "direction", "amount_kr", (F.lit(opening_kr) + F.col("running_kr")).alias("running_kr"))


#: What each tab of the invoice page shows.
TABS = {
    "giden": "direction = 'SATIS' and document = 'E_FATURA' and state <> 'TASLAK'", "gelen": "direction = 'ALIS'",
    "earsiv": "document = 'E_ARSIV' and state <> 'TASLAK'", "taslak": "state = 'TASLAK'",
}
PAID = {"acik": "paid_kr = 0", "kismi": "paid_kr > 0 and open_kr > 0", "odendi": "open_kr = 0"}
SORTS = {"tarih_desc": [F.desc, "date"], "tarih_asc": [F.asc, "date"], "tutar_desc": [F.desc, "gross_kr"]}


def settled(invoices: DataFrame, allocated: DataFrame) -> DataFrame:
    """`invoices` (direction, no, net_debt_kr) with paid_kr and open_kr by `allocated` (direction, no, amount_kr)."""
    paid = allocated.groupBy("direction", "no").agg(total("amount_kr").alias("paid_kr"))
    out = invoices.join(paid, ["direction", "no"], "left").withColumn("paid_kr", F.coalesce("paid_kr", F.lit(0)))
    return out.withColumn("open_kr", F.col("net_debt_kr") - F.col("paid_kr"))


def found_invoices(
    invoices: DataFrame, allocated: DataFrame | None = None, text: str | None = None, party: int | None = None, direction: str | None = None, instrument: str | None = None, low_kr: int | None = None, high_kr: int | None = None,
    since: str | None = None, until: str | None = None, tab: str | None = None, state: str | None = None, paid: str | None = None, allocatable: bool = False,
) -> DataFrame:
    """The `invoices` (of `settled`) that meet all filters that are given.

    An instrument is met by an invoice's own or by that of any of its allocations, `allocated` (direction, no, instrument): an invoice
    paid by two is found by both.  What was returned or discounted whole has nothing open without being paid, so `allocatable` asks for more than `acik`.
    """
    c = F.col
    given = [
        (text, lambda: F.contains(F.lower(F.concat_ws(" ", c("no"), c("name"))), F.lit(text.lower()))), (party, lambda: c("party") == party), (direction, lambda: c("direction") == direction),
        (low_kr, lambda: c("gross_kr") >= low_kr), (high_kr, lambda: c("gross_kr") <= high_kr), (since, lambda: c("date") >= F.lit(since).cast("date")), (until, lambda: c("date") <= F.lit(until).cast("date")),
        (tab, lambda: F.expr(TABS[tab])), (state, lambda: c("state") == state), (paid, lambda: F.expr(PAID[paid])), (allocatable or None, lambda: c("valid") & (c("open_kr") > 0)),
    ]
    for value, condition in given:
        if value is not None:
            invoices = invoices.where(condition())
    if instrument is not None:
        by = allocated.where(c("instrument") == instrument).select("direction", "no").distinct().withColumn("_by", F.lit(True))
        invoices = invoices.join(by, ["direction", "no"], "left").where((c("instrument") == instrument) | c("_by")).drop("_by")
    return invoices


def invoice_page(found: DataFrame, sort: str = "tutar_desc", offset: int = 0, limit: int = 50) -> DataFrame:
    """One page, of 200 invoices at most; equal ones by direction and number."""
    way, column = SORTS[sort]
    page = found.orderBy(way(column), "direction", "no").offset(offset).limit(min(limit, 200))
    return page.select("direction", "no", "party", "date", "state", "instrument", "gross_kr", "paid_kr", "open_kr")


def invoice_totals(found: DataFrame) -> DataFrame:
    """What is found in all, before it is cut into pages."""
    return found.agg(F.count("*").alias("n"), total("open_kr").alias("open_kr"))


def invoice_tabs(invoices: DataFrame) -> DataFrame:
    return invoices.groupBy("state").agg(F.count("*").alias("n"), total("gross_kr").alias("gross_kr"), total("net_debt_kr").alias("net_debt_kr"))


def party_summary(invoices: DataFrame, allocated: DataFrame) -> DataFrame:
    """Invoiced, paid and open amounts of each party."""
    paid = allocated.groupBy("no").agg(total("amount_kr").alias("paid_kr"))
    met = invoices.where("valid").join(paid, "no", "left").groupBy("party").agg(F.count("*").alias("n"), total("net_debt_kr").alias("debt_kr"), total("paid_kr").alias("paid_kr"))
    return met.withColumn("open_kr", F.col("debt_kr") - F.col("paid_kr"))
