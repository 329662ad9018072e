"""Tax returns as they are filed: monthly offset vouchers, the sections of the VAT return, advance corporate tax with what is added and exempt.

Lines that a person adds to a return (`manual`) change the return and never the ledger.  Everything is aggregated to a row for each month
and sub-account before any window runs, so that windows see the calendar and the chart, not the journal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.accounts import child_of
from tallyspark.functions.money import div, percent, total

#: Kind of the vouchers that close the month's VAT; they are no source of a return.
OFFSET = "vat_offset"
#: Rate of a sub-account that the catalogue does not know.
GENERAL_RATE = 20
COMPUTED, DEDUCTED = "hesaplanan", "indirim"


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def monthly_offsets(journal: DataFrame) -> DataFrame:
    """month, line_no, account, debit_kr, credit_kr: the voucher at the end of each month that has VAT lines.

    Each leaf of 391 with a credit balance is debited, each leaf of 191 and 190 with a debit balance credited, and the difference goes to 360 or
    is carried on 190.  A leaf of the wrong sign stays open and counts in later months: what is closed until a month is the highest
    running balance so far, or 0, and a month closes the rise of it.
    """
    signed = F.when(F.col("account").startswith("391"), F.col("credit_kr") - F.col("debit_kr")).otherwise(F.col("debit_kr") - F.col("credit_kr"))
    leaf = journal.where(child_of("account", "391") | child_of("account", "191") | child_of("account", "190")).where(~F.col("kind").eqNullSafe(OFFSET)).groupBy(F.trunc("date", "month").alias("month"), "account").agg(total(signed).alias("net_kr"))
    own = Window.partitionBy("account").orderBy("month")
    run = leaf.withColumn("run", F.sum("net_kr").over(own)).withColumn("top", F.greatest(F.max("run").over(own), _zero()))
    closed = run.withColumn("closed_kr", F.col("top") - F.coalesce(F.lag("top").over(own), _zero())).select("month", "account", "closed_kr")
    out = F.col("account").startswith("391")
    months = closed.groupBy("month").agg(total(F.when(out, -F.col("closed_kr")).otherwise(F.col("closed_kr"))).alias("surplus_kr"), total(F.when(F.col("account") == "190", F.col("closed_kr")).otherwise(0)).alias("first_kr"))
    w = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)  # a row a month
    months = months.withColumn("sum", F.sum("surplus_kr").over(w)).withColumn("carry_kr", F.col("sum") - F.least(F.min("sum").over(w), _zero()))
    months = months.withColumn("carried_kr", F.coalesce(F.lag("carry_kr").over(Window.orderBy("month")), _zero()))
    legs = closed.where((F.col("closed_kr") > 0) & (F.col("account") != "190")).select("month", F.when(out, 1).otherwise(2).alias("part"), "account", F.when(out, F.col("closed_kr")).otherwise(_zero()).alias("debit_kr"), F.when(out, _zero()).otherwise(F.col("closed_kr")).alias("credit_kr"))
    left = F.col("surplus_kr") + F.col("carried_kr")
    leg = lambda part, account, debit, credit: F.struct(F.lit(part).alias("part"), F.lit(account).alias("account"), debit.alias("debit_kr"), credit.alias("credit_kr"))
    rest = months.select("month", F.inline(F.array(leg(3, "190", _zero(), F.col("carried_kr") + F.col("first_kr")), leg(4, "360", _zero(), F.greatest(-left, _zero())), leg(4, "190", F.greatest(left, _zero()), _zero()))))
    lines = legs.unionByName(rest.where("debit_kr > 0 or credit_kr > 0"))
    return lines.select("month", F.row_number().over(Window.partitionBy("month").orderBy("part", "account")).alias("line_no"), "account", "debit_kr", "credit_kr")


def offset_lines(offsets: DataFrame) -> DataFrame:
    """`monthly_offsets` as lines of a journal: dated at the month's end, numbered by month."""
    number = F.date_format("month", "yyyyMM").cast("bigint")
    return offsets.select((F.lit(9_000_000_000_000) + number).alias("voucher"), F.lit(OFFSET).alias("kind"), "line_no", F.last_day("month").alias("date"), "account", "debit_kr", "credit_kr", number.alias("doc_no"))


def _leaves(journal: DataFrame) -> DataFrame:
    """month, account, side, vat_kr of each leaf of 391 and 191, without the offset vouchers."""
    computed = F.col("account").startswith("391")
    net = F.when(computed, F.col("credit_kr") - F.col("debit_kr")).otherwise(F.col("debit_kr") - F.col("credit_kr"))
    own = journal.where((child_of("account", "391") | child_of("account", "191")) & ~F.col("kind").eqNullSafe(OFFSET))
    return own.groupBy(F.trunc("date", "month").alias("month"), "account").agg(total(net).alias("vat_kr")).withColumn("side", F.when(computed, COMPUTED).otherwise(DEDUCTED))


def _by_rate(account: Column, rates: dict[str, int]) -> Column:
    known = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair]) if rates else F.create_map().cast("map<string,int>")
    return F.coalesce(F.element_at(known, account), F.lit(GENERAL_RATE)).cast("int")


def vat_sections(journal: DataFrame, invoices: DataFrame, manual: DataFrame, rates: dict[str, int]) -> DataFrame:
    """month, section, code, rate, base_kr, vat_kr, withheld_kr, documents: each part of the return as rows.

    `rates`: sub-account to rate (a bounded catalogue).  Computed and deducted VAT are what leaves have above 0, with the base that their rate implies.
    Exempt and withheld sales leave no trace in the leaves, so they come from the invoices (valid, direction, date, net_kr, vat_kr, withheld_kr, and
    return_net_kr, discount_net_kr); neither is added to computed VAT.
    """
    c, none = F.col, F.lit(None)
    rate = _by_rate(c("account"), rates)
    taxed = _leaves(journal).where("vat_kr > 0").select("month", c("side").alias("section"), c("account").alias("code"), rate.alias("rate"), div(c("vat_kr") * 100, F.when(rate > 0, rate)).alias("base_kr"), "vat_kr", _zero().alias("withheld_kr"), none.cast("bigint").alias("documents"))
    sold = invoices.where("valid and direction = 'SATIS'").withColumn("month", F.trunc("date", "month"))
    row = lambda df, name, base, vat, held: df.groupBy("month").agg(total(base).alias("base_kr"), total(vat).alias("vat_kr"), total(held).alias("withheld_kr"), F.count("*").alias("documents")).withColumns({"section": F.lit(name), "code": none.cast("string"), "rate": none.cast("int")})
    exempt = row(sold.where("vat_kr = 0"), "istisna", c("net_kr") - c("return_net_kr") - c("discount_net_kr"), _zero(), _zero())
    held = row(sold.where("withheld_kr > 0"), "tevkifat", c("net_kr"), c("vat_kr"), c("withheld_kr"))
    added = manual.select("month", F.concat(F.lit("manuel "), c("direction")).alias("section"), c("name").alias("code"), none.cast("int").alias("rate"), "base_kr", "vat_kr", _zero().alias("withheld_kr"), none.cast("bigint").alias("documents"))
    return taxed.unionByName(exempt).unionByName(held).unionByName(added)


def vat_filed(journal: DataFrame, manual: DataFrame) -> DataFrame:
    """month, computed_kr, carried_in_kr, deductible_kr, deductions_kr, payable_kr, carried_out_kr of each month with VAT lines or manual ones.

    What is carried in is the debit balance of 190 at the end of the month before, or 0: what offset vouchers have really posted.
    """
    leaves = _leaves(journal).groupBy("month").agg(total(F.when(F.col("side") == COMPUTED, F.greatest("vat_kr", _zero())).otherwise(0)).alias("own"), total(F.when(F.col("side") == DEDUCTED, F.col("vat_kr")).otherwise(0)).alias("deductible_kr"))
    side = lambda name: total(F.when(F.col("direction") == name, F.col("vat_kr")).otherwise(0))
    added = manual.groupBy("month").agg(side(COMPUTED).alias("added"), side(DEDUCTED).alias("deducted"))
    kept = journal.where(child_of("account", "190")).groupBy(F.trunc("date", "month").alias("month")).agg(total(F.col("debit_kr") - F.col("credit_kr")).alias("kept"))
    all_ = leaves.join(added, "month", "full").join(kept, "month", "full")
    shown = F.col("own").isNotNull() | F.col("added").isNotNull()
    all_ = all_.withColumn("shown", shown).withColumn("carried_in_kr", F.greatest(F.coalesce(F.sum("kept").over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, -1)), _zero()), _zero())).where("shown").na.fill(0, ["own", "deductible_kr", "added", "deducted"])
    computed, all_off = F.col("own") + F.col("added"), F.col("deductible_kr") + F.col("carried_in_kr") + F.col("deducted")
    return all_.select("month", computed.alias("computed_kr"), "carried_in_kr", "deductible_kr", all_off.alias("deductions_kr"), F.greatest(computed - all_off, _zero()).alias("payable_kr"), F.greatest(all_off - computed, _zero()).alias("carried_out_kr"))


def advance_tax_filed(journal: DataFrame, manual: DataFrame, rate: int = 25) -> DataFrame:
    """Each quarter of each year with profit-and-loss lines: what the year has earned so far, what is added and exempt, the tax on it, less the quarter before's.

    Non-deductible expense on 689 is added back by itself; `manual` (year, quarter, kind, amount_kr) has 'kkeg' and 'istisna' of one quarter's return.
    """
    own = journal.where("account LIKE '6%' AND account NOT LIKE '69%'").groupBy(F.year("date").alias("year"), F.quarter("date").alias("quarter"))
    own = own.agg(total(F.col("credit_kr") - F.col("debit_kr")).alias("earned"), total(F.when(child_of("account", "689"), F.col("debit_kr") - F.col("credit_kr")).otherwise(0)).alias("refused"))
    every = own.select("year").distinct().withColumn("quarter", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))))
    side = lambda name: total(F.when(F.col("kind") == name, F.col("amount_kr")).otherwise(0))
    added = manual.groupBy("year", "quarter").agg(side("kkeg").alias("added_kr"), side("istisna").alias("exempt_kr"))
    w = Window.partitionBy("year").orderBy("quarter")
    rows = every.join(own, ["year", "quarter"], "left").join(added, ["year", "quarter"], "left").na.fill(0, ["earned", "refused", "added_kr", "exempt_kr"])
    rows = rows.withColumn("profit_kr", F.sum("earned").over(w)).withColumn("refused_kr", F.greatest(F.sum("refused").over(w), _zero()))
    rows = rows.withColumn("base_kr", F.greatest(F.col("profit_kr") + F.col("refused_kr") + F.col("added_kr") - F.col("exempt_kr"), _zero()))
    rows = rows.withColumn("computed_kr", percent("base_kr", rate)).withColumn("before_kr", F.coalesce(F.lag("computed_kr").over(w), _zero()))
    return rows.select("year", "quarter", "profit_kr", "refused_kr", "added_kr", "exempt_kr", "base_kr", "computed_kr", "before_kr", F.greatest(F.col("computed_kr") - F.col("before_kr"), _zero()).alias("payable_kr"))
