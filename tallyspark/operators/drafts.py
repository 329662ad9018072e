"""From a read invoice to the voucher that may be posted for it, withholding included.

The VAT rate is not asked for but follows from tax and base; a rate that the catalogue does not know gives no sub-account, and a finding.
A document that is no invoice, is incomplete or blocked has no lines at all: a draft that must not be posted is not shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.money import half_away

DRAFT, OTHER, INCOMPLETE, BLOCKED = "TASLAK", "TUR", "EKSIK", "ENGEL"


def from_fields(values: DataFrame, required: list[str], amounts: dict[str, str], texts: dict[str, str]) -> DataFrame:
    """`values` (doc_id, field, value, number, approved, as `candidates.filled` gives them) to a row for each document.

    `amounts` and `texts`: column to field.  `complete` if each of `required` is approved and has a value.
    """
    one = lambda field, x: F.max(F.when(F.col("field") == field, F.col(x)))
    have = F.count_distinct(F.when(F.col("approved") & (F.trim(F.coalesce("value", F.lit(""))) != "") & F.col("field").isin(required), F.col("field")))
    return values.groupBy("doc_id").agg(*[one(f, "number").alias(c) for c, f in amounts.items()], *[one(f, "value").alias(c) for c, f in texts.items()], (have == len(set(required))).alias("complete"))


def drafts(documents: DataFrame, rates: dict[int, str]) -> DataFrame:
    """doc_id, status, rate, findings, lines (line_no, account, debit_kr, credit_kr).

    `documents`: doc_id, kind, direction, complete, base_kr, vat_kr, total_kr, withheld_kr (null: 0); `rates`: rate to sub-account code.
    A30: the rate is not in the catalogue; A31: debit and credit differ; A32: more is withheld than the tax.  A31 and A32 block.  The
    party owes or is owed the total less what is withheld; a buyer books the withheld tax as deductible and as owed to the state.
    """
    zero = F.lit(0).cast("bigint")
    amount = lambda x: F.coalesce(F.col(x), zero).cast("bigint")
    base, vat, whole, held = amount("base_kr"), amount("vat_kr"), amount("total_kr"), F.greatest(amount("withheld_kr"), zero)
    rate = F.when(base > 0, half_away(vat * 100, F.when(base > 0, base).otherwise(1))).otherwise(zero)
    known = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair]) if rates else F.create_map().cast("map<int,string>")
    code = F.element_at(known, rate.cast("int"))
    leaf = lambda main: F.when(code.isNull(), F.lit(main)).otherwise(F.concat(F.lit(main + "."), code))
    sale = F.startswith(F.upper(F.translate(F.coalesce("direction", F.lit("")), "şŞ", "sS")), F.lit("SATIS"))
    own, due = F.greatest(vat - held, zero), F.greatest(whole - held, zero)

    def line(account: str | Column, debit: Column, credit: Column, where: Column | None = None) -> Column:
        made = F.struct((F.lit(account) if isinstance(account, str) else account).alias("account"), debit.alias("debit_kr"), credit.alias("credit_kr"))
        return made if where is None else F.when(where, made)

    sold = F.array(line("120", due, zero), line("600", zero, base), line(leaf("391"), zero, own, own > 0))
    bought = F.array(line("153", base, zero), line(leaf("191"), own, zero, own > 0), line(leaf("191"), held, zero, held > 0), line("360", zero, held, held > 0), line("320", zero, due))
    legs = F.array_compact(F.when(sale, sold).otherwise(bought))
    both = lambda side: F.aggregate(F.col("legs"), zero, lambda a, x: a + x[side])
    out = documents.withColumns({"rate": rate, "legs": legs, "unknown": (vat > 0) & code.isNull(), "excess": held > vat})
    out = out.withColumn("uneven", both("debit_kr") != both("credit_kr"))
    status = F.when(F.coalesce("kind", F.lit("")) != "FATURA", OTHER).when(~F.coalesce("complete", F.lit(False)), INCOMPLETE).when(F.col("excess") | F.col("uneven"), BLOCKED).otherwise(DRAFT)
    out = out.withColumn("status", status)
    tried = F.col("status").isin(DRAFT, BLOCKED)
    said = F.array_compact(F.array(*[F.when(tried & F.col(x), F.lit(k)) for k, x in (("A30", "unknown"), ("A32", "excess"), ("A31", "uneven"))]))
    numbered = F.transform("legs", lambda x, i: F.struct((i + 1).alias("line_no"), x["account"].alias("account"), x["debit_kr"].alias("debit_kr"), x["credit_kr"].alias("credit_kr")))
    return out.select("doc_id", "status", F.when(tried, F.col("rate")).alias("rate"), F.array_join(said, ",").alias("findings"), F.when(F.col("status") == DRAFT, numbered).alias("lines"))


def draft_lines(made: DataFrame) -> DataFrame:
    """The lines of what `drafts` allows: doc_id, line_no, account, debit_kr, credit_kr."""
    return made.where(F.col("status") == DRAFT).select("doc_id", F.inline("lines"))
