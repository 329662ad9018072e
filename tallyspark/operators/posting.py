"""Posting rules: from documents to journal lines, and the checks and numbers of vouchers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.money import div, kurus, percent_half_up, total
from tallyspark.sources.scratch import written

KINDS = {"accrual": 1, "void": 2, "return": 3, "cost": 4, "discount": 5, "purchase": 6, "receipt": 8}
BASE = 1_000_000_000_000
RECEIPT_ACCOUNTS = {"BANKA": "102", "NAKIT": "100", "CEK": "101", "SENET": "121"}
JOURNAL = ["voucher", "kind", "line_no", "date", "account", "debit_kr", "credit_kr", "doc_no"]


def posted(docs: DataFrame, kind: str, legs: list[tuple]) -> DataFrame:
    """A voucher for each row of `docs` (no, date): `legs` are (account, debit, credit); legs without an amount drop out."""
    zero = F.lit(0).cast("bigint")
    of = lambda x: zero if isinstance(x, int) else (F.col(x) if isinstance(x, str) else x).cast("bigint")
    lines = [F.struct(F.lit(i).alias("line_no"), (F.lit(a) if isinstance(a, str) else a).alias("account"), of(d).alias("debit_kr"), of(c).alias("credit_kr")) for i, (a, d, c) in enumerate(legs, 1)]
    number = (F.col("no") + F.lit(KINDS[kind] * BASE)).alias("voucher")
    rows = docs.select(number, F.lit(kind).alias("kind"), "date", F.col("no").alias("doc_no"), F.inline(F.array(*lines)))
    return rows.where("debit_kr > 0 or credit_kr > 0").select(JOURNAL)


def party(prefix: str) -> Column:
    return F.concat(F.lit(prefix + "."), F.col("party").cast("string"))


def sale_accruals(sales: DataFrame) -> DataFrame:
    """Customer against revenue (export apart) and VAT of each rate; drafts are not posted."""
    revenue = F.when(F.col("export"), "601").otherwise("600")
    vat = [(f"391.0{r}", 0, f"vat{r}") for r in range(1, 9)]
    return posted(sales.where("state <> 'TASLAK'"), "accrual", [(party("120"), "gross_kr", 0), (revenue, 0, "net_kr"), *vat])


def voids(lines: DataFrame) -> DataFrame:
    """Full reversals; what they reverse stays."""
    return reversed_lines(lines, F.col("voucher") + BASE).withColumn("kind", F.lit("void"))


def reversed_lines(lines: DataFrame, voucher: Column) -> DataFrame:
    swapped = {"debit_kr": F.col("credit_kr"), "credit_kr": F.col("debit_kr"), "voucher": voucher}
    return lines.select(*[swapped.get(c, F.col(c)).alias(c) for c in lines.columns])


def sale_returns(sales: DataFrame) -> DataFrame:
    """Returns go to 610; revenue is never reversed."""
    both = F.col("return_net_kr") + F.col("return_vat_kr")
    return posted(sales.where("valid and return_net_kr > 0"), "return", [("610", "return_net_kr", 0), ("191.01", "return_vat_kr", 0), (party("120"), 0, both)])


def costs(sales: DataFrame) -> DataFrame:
    """Cost of what was sold, and back to stock the returned share."""
    back = div(F.col("cost_kr") * F.col("return_net_kr"), F.col("net_kr"))
    return posted(sales.where("valid and net_kr > 0"), "cost", [("621", "cost_kr", 0), ("153", 0, "cost_kr"), ("153", back, 0), ("621", 0, back)])


def discounts(sales: DataFrame) -> DataFrame:
    both = F.col("discount_net_kr") + F.col("discount_vat_kr")
    return posted(sales.where("valid and discount_net_kr > 0"), "discount", [("611", "discount_net_kr", 0), ("191.01", "discount_vat_kr", 0), (party("120"), 0, both)])


def purchase_accruals(purchases: DataFrame) -> DataFrame:
    return posted(purchases, "purchase", [("153", "net_kr", 0), ("191.02", "vat_kr", 0), (party("320"), 0, "gross_kr")])


def receipt_vouchers(receipts: DataFrame) -> DataFrame:
    account = F.coalesce(*[F.when(F.col("instrument") == k, v) for k, v in RECEIPT_ACCOUNTS.items()])
    return posted(receipts.withColumnRenamed("id", "no"), "receipt", [(account, "amount_kr", 0), (party("120"), 0, "amount_kr")])


def opening(customers: DataFrame, suppliers: DataFrame, date: str = "1994-12-31") -> DataFrame:
    """One voucher from account balances; capital takes the difference."""
    c = customers.select(F.concat(F.lit("120."), F.col("c_custkey").cast("string")).alias("account"), kurus("c_acctbal").alias("net_kr"), F.lit(1).alias("line_no"))
    s = suppliers.select(F.concat(F.lit("320."), F.col("s_suppkey").cast("string")).alias("account"), (-kurus("s_acctbal")).alias("net_kr"), F.lit(2).alias("line_no"))
    both = c.unionByName(s)
    rest = both.agg((-total("net_kr")).alias("net_kr")).select(F.lit("500").alias("account"), "net_kr", F.lit(3).alias("line_no"))
    return opening_lines(both.unionByName(rest), date)


def opening_lines(balances: DataFrame, date: str) -> DataFrame:
    """`balances` (account, net_kr, line_no) as an opening voucher."""
    zero = F.lit(0).cast("bigint")
    return balances.where("net_kr <> 0").select(
        zero.alias("voucher"), F.lit("opening").alias("kind"), "line_no", F.lit(date).cast("date").alias("date"), "account",
        F.greatest("net_kr", zero).alias("debit_kr"), F.greatest(-F.col("net_kr"), zero).alias("credit_kr"), zero.alias("doc_no"),
    )


def net_debt() -> Column:
    left = F.col("gross_kr") - F.col("return_net_kr") - F.col("return_vat_kr") - F.col("discount_net_kr") - F.col("discount_vat_kr")
    return F.when(F.col("valid"), F.greatest(left, F.lit(0))).otherwise(0)


def invoice_totals(lines: DataFrame) -> DataFrame:
    """`lines` (no, qty, unit_kr, rate, exempt): net, VAT (half up, none where exempt), gross of each invoice."""
    net = F.col("qty") * F.col("unit_kr")
    vat = F.when(F.col("exempt"), 0).otherwise(percent_half_up(net, "rate"))
    return lines.groupBy("no").agg(total(net).alias("net_kr"), total(vat).alias("vat_kr"), total(net + vat).alias("gross_kr"))


def voucher_types(journal: DataFrame) -> DataFrame:
    """Receipt if only debits touch cash and banks (100, 101, 102), payment if only credits do, general otherwise."""
    liquid = F.substring("account", 1, 3).isin("100", "101", "102")
    inflow, outflow = F.bool_or(liquid & (F.col("debit_kr") > 0)), F.bool_or(liquid & (F.col("credit_kr") > 0))
    return journal.groupBy("voucher").agg(inflow.alias("i"), outflow.alias("o")).select(
        "voucher", F.when(F.col("i") & ~F.col("o"), "Tahsil").when(F.col("o") & ~F.col("i"), "Tediye").otherwise("Mahsup").alias("type")
    )


#: Voucher types that need a document or reference behind them, fixed values.
NEED_EVIDENCE = ["TAHSIL", "TEDIYE"]


def validate(lines: DataFrame, postable: DataFrame, period_start: str, period_end: str, period_open: bool = True) -> DataFrame:
    """First failing rule of each voucher of `lines` (voucher, line_no, date, status, kind, evidence, account, debit_kr, credit_kr).

    In this order: it is final already; V2 fewer than two lines; line by line V3 not exactly one side with an amount, or a
    negative one, then V4 an account that cannot be posted to; V5 a closed period; V6 a date outside it; V1 debits are not
    credits; V7 a voucher of a kind that needs evidence has none.
    """
    # The chart is of bounded size; without the broadcast all lines would gather by account, of which there are few.
    known = lines.join(F.broadcast(postable.select(F.col("code").alias("account"), F.lit(True).alias("known"))), "account", "left")
    amount = ((F.col("debit_kr") > 0) == (F.col("credit_kr") > 0)) | (F.col("debit_kr") < 0) | (F.col("credit_kr") < 0)
    # Line and rule in one number: the least of structs would sort all lines, that of numbers is kept in a hash table.
    bad = 2 * F.coalesce(F.col("line_no").cast("bigint"), F.lit(-(1 << 40))) + F.when(amount, 0).when(F.col("known").isNull(), 1)
    seen = known.groupBy("voucher").agg(
        F.bool_or(F.col("status") == "Kesin").alias("final"), F.count("*").alias("n"), F.min(bad).alias("line"), F.min("date").alias("date"), (F.sum("debit_kr") - F.sum("credit_kr")).alias("off"),
        F.bool_or(F.col("kind").isin(NEED_EVIDENCE) & F.col("evidence").isNull()).alias("bare"),
    )
    outside = ~F.col("date").between(F.lit(period_start).cast("date"), F.lit(period_end).cast("date"))
    rules = [F.when(F.col("final"), "FINAL"), F.when(F.col("n") < 2, "V2"), F.when(F.col("line") % 2 == 0, "V3").when(F.col("line").isNotNull(), "V4"), F.when(F.lit(not period_open), "V5"), F.when(outside, "V6"), F.when(F.col("off") != 0, "V1"), F.when(F.col("bare"), "V7"), F.lit("OK")]
    return seen.select("voucher", F.coalesce(*rules).alias("rule"))


def numbered(vouchers: DataFrame, *order: str, series: str = "series") -> DataFrame:
    """`vouchers` with gapless numbers: `serial` within each series and `journal_no` over all, in `order`.

    The rows are range-partitioned by the order; counts of each part and series (a small table) give the parts' bases, so
    no task sees more than its part.
    """
    # Written, so that the counts and the rows come from one division into ranges.
    parts = written(vouchers.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = parts.groupBy("_part", series).count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base_all = counts.groupBy("_part").agg(F.sum("count").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_all"))
    base_own = counts.select("_part", series, F.coalesce(F.sum("count").over(Window.partitionBy(series).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_own"))
    at, own = Window.partitionBy("_part").orderBy(*order), Window.partitionBy("_part", series).orderBy(*order)
    out = parts.withColumn("_a", F.row_number().over(at)).withColumn("_o", F.row_number().over(own))
    out = out.join(F.broadcast(base_all), "_part").join(F.broadcast(base_own), ["_part", series])
    return out.select(*vouchers.columns, (F.col("_own") + F.col("_o")).alias("serial"), (F.col("_all") + F.col("_a")).alias("journal_no"))


def duplicate_documents(vouchers: DataFrame) -> DataFrame:
    """Vouchers (voucher, doc_type, doc_no, date) whose document another voucher with a smaller number has."""
    w = Window.partitionBy("doc_type", "doc_no").orderBy("voucher")
    return vouchers.withColumn("first_voucher", F.first("voucher").over(w)).where("voucher <> first_voucher")


def approval_breaches(totals: DataFrame, levels: DataFrame) -> DataFrame:
    """`totals` (voucher, level, debit_kr) above their level's limit; 0 means none, the administrator is exempt."""
    met = totals.join(F.broadcast(levels), "level", "left")
    return met.where((F.coalesce("limit_kr", F.lit(0)) > 0) & (F.col("level") != "YONETICI") & (F.col("debit_kr") > F.col("limit_kr")))
