"""Instalments and the movements that pay them; the chain from an invoice to its vouchers, its money and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.money import total
from tallyspark.operators.running import PART, ranged, running
from tallyspark.sources.scratch import written

GROUP = ["direction", "amount_kr", "name"]


def instalments(items: DataFrame, movements: DataFrame, as_of: str) -> DataFrame:
    """`items` (no, part, direction, amount_kr, name, date, due) with the movement that pays each and its status.

    `movements` (ref, direction, amount_kr, name, date).  Items in order of date, invoice and part each take the first movement
    that is left, by date and ref, of their direction, exact amount and name, dated no earlier than the invoice.  With f(i)
    the place of the first movement that an item may take, item i of its group takes the one at i + max over k <= i of
    f(k) - k, if there are as many: the loop unrolled, so nothing gathers.
    Status: TAHSIL, else GECIKMIS if due before `as_of`, else BEKLIYOR.
    """
    none = F.lit(None).cast("bigint")
    i = items.select(*GROUP, "date", F.lit(0).alias("side"), F.col("no").alias("key"), F.col("part").cast("bigint").alias("part"), "due")
    m = movements.select(*GROUP, "date", F.lit(1).alias("side"), F.col("ref").alias("key"), none.alias("part"), F.lit(None).cast("date").alias("due"))
    order = ["date", "side", "key", "part"]
    of = lambda side: F.when(F.col("side") == side, 1).otherwise(0)
    both = written(running(ranged(i.unionByName(m), GROUP, order), GROUP, order, {"items": (F.sum, of(0)), "seen": (F.sum, of(1))}), "counts")
    # Before an item stand the movements that are too early for it.
    both = running(both, GROUP, order, {"ahead": (F.max, F.when(F.col("side") == 0, F.col("seen") + 1 - F.col("items")))}).drop(PART)
    both = written(both, "places")
    wanted = both.where("side = 0").select(*GROUP, F.col("key").alias("no"), "part", "due", (F.col("items") + F.col("ahead")).alias("place"))
    paid = both.where("side = 1").select(*GROUP, F.col("seen").alias("place"), F.col("key").alias("ref"), F.col("date").alias("paid_on"))
    met = wanted.join(paid, [*GROUP, "place"], "left")
    status = F.when(F.col("ref").isNotNull(), "TAHSIL").when(F.col("due") < F.lit(as_of).cast("date"), "GECIKMIS").otherwise("BEKLIYOR")
    return met.select("no", "part", "amount_kr", status.alias("status"), "ref", "paid_on")


def unmatched(movements: DataFrame, matched: DataFrame) -> DataFrame:
    """Movements that pay no instalment: they wait for a decision."""
    return movements.join(matched.where("ref is not null").select("ref"), "ref", "left_anti")


def node(kind: str, key: str | Column) -> Column:
    return F.concat(F.lit(kind + ":"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def provenance(invoices: DataFrame, receipts: DataFrame, allocated: DataFrame, vouchers: DataFrame) -> DataFrame:
    """Edges (source, target, kind, amount_kr) between invoices, their vouchers, receipts, and the banks that these came through.

    `vouchers` are (voucher, kind, doc_no, amount_kr).  Each step is a join on one key, so a chain of any part is a few joins.
    """
    edge = lambda df, a, b, kind, amount: df.select(a.alias("source"), b.alias("target"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), F.col(amount).cast("bigint").alias("amount_kr"))
    booked = vouchers.where("kind <> 'receipt'").join(invoices.select(F.col("no").alias("doc_no")), "doc_no")
    paid = vouchers.where("kind = 'receipt'").join(receipts.select(F.col("id").alias("doc_no")), "doc_no")
    return (
        edge(booked, node("invoice", "doc_no"), node("voucher", "voucher"), F.col("kind"), "amount_kr")
        .unionByName(edge(allocated, node("receipt", "id"), node("invoice", "no"), "allocation", "amount_kr"))
        .unionByName(edge(paid, node("receipt", "doc_no"), node("voucher", "voucher"), "receipt", "amount_kr"))
        .unionByName(edge(receipts.where("bank is not null"), node("bank", "bank"), node("receipt", "id"), "bank", "amount_kr"))
    )


def provenance_confidence(invoices: DataFrame, allocated: DataFrame) -> DataFrame:
    """How far an invoice's chain reaches: TAM (100) if nothing of it is open, KISMI (60) if some of its debt is traced to money, else ESLESMEYEN (30).

    An invoice without debt has nothing open.
    """
    paid = allocated.groupBy("no").agg(total("amount_kr").alias("paid_kr"))
    out = invoices.join(paid, "no", "left").withColumn("paid_kr", F.coalesce("paid_kr", F.lit(0)))
    level = F.when(F.col("paid_kr") >= F.col("net_debt_kr"), "TAM").when(F.col("paid_kr") > 0, "KISMI").otherwise("ESLESMEYEN")
    return out.select("no", "net_debt_kr", "paid_kr", level.alias("level"), F.when(level == "TAM", 100).when(level == "KISMI", 60).otherwise(30).alias("confidence"))
