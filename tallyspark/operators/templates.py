"""Voucher templates: what a saved one must fulfil, which of several of a name holds, and how often each is used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import accounts as A
from tallyspark.operators.ledger import kinds
from tallyspark.sources.scratch import written

#: Characters of a name at most.
LONGEST = 60


def template_findings(saves: DataFrame, chart: DataFrame, built_in: DataFrame) -> DataFrame:
    """The first thing that is wrong with each of `saves` (save, name, line_no, side, code; a save without lines has one with null side and code), null if nothing is:

    T01 name of 1 to 60 characters, T02 two lines or more, T03 a debit (B) and a credit (A) line, else no amount could balance it,
    T04 codes of the chart (exact ones), T05 a name that no template of `built_in` (name) has.
    """
    met = saves.withColumn("name", F.trim("name")).join(chart.select("code").distinct().withColumn("known", F.lit(True)), "code", "left")
    by = met.groupBy("save").agg(
        F.max("name").alias("name"), F.count("side").alias("n"), F.coalesce(F.bool_or(F.col("side") == "B"), F.lit(False)).alias("debit"), F.coalesce(F.bool_or(F.col("side") == "A"), F.lit(False)).alias("credit"),
        F.coalesce(F.bool_or(F.col("side").isNotNull() & F.col("known").isNull()), F.lit(False)).alias("strange"),
    )
    by = by.join(built_in.select("name").distinct().withColumn("taken", F.lit(True)), "name", "left")
    length = F.coalesce(F.length("name"), F.lit(0))
    code = F.when((length < 1) | (length > LONGEST), "T01").when(F.col("n") < 2, "T02").when(~F.col("debit") | ~F.col("credit"), "T03").when(F.col("strange"), "T04").when(F.col("taken"), "T05")
    return by.select("save", "name", "n", code.alias("code"))


def current(saves: DataFrame, findings: DataFrame) -> DataFrame:
    """Lines (name, line_no, side, code) of the last faultless save of each name; saves are in order of their numbers."""
    last = findings.where("code is null").groupBy("name").agg(F.max("save").alias("save"))
    return saves.drop("name").join(last, "save").select("name", "line_no", "side", "code")


def shapes(lines: DataFrame, key: str) -> DataFrame:
    """The shape of each `key`: how many accounts on how many sides it has, and two sums over them that tell shapes apart.

    Sums combine before they are shuffled, so a voucher of a million lines is not gathered; two sums of 64-bit hashes of different
    seeds stand for the set, so that two shapes of one size are taken for one about once in 2 ** 128 pairs.
    """
    parts = lines.select(key, "side", "code").distinct()
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), "side", "code").cast("decimal(38,0)"))
    return parts.groupBy(key).agg(F.count("*").alias("size"), h(1).alias("h1"), h(2).alias("h2"))


def template_list(built_in: DataFrame, user: DataFrame, journal: DataFrame) -> DataFrame:
    """All templates by name, with their number of lines and of vouchers of exactly their accounts and sides (sub-accounts count as their ledger account)."""
    all_of = built_in.withColumn("user", F.lit(False)).unionByName(user.withColumn("user", F.lit(True)))
    own = written(kinds(journal), "kinds").select("voucher", F.when(F.col("debit"), "B").otherwise("A").alias("side"), "code", "vouchers")
    counts = own.select("voucher", "vouchers").distinct()
    shaped = shapes(own, "voucher").withColumnRenamed("voucher", "one")
    used = shaped.join(counts, F.col("one").eqNullSafe(F.col("voucher"))).groupBy("size", "h1", "h2").agg(F.sum("vouchers").alias("usage"))
    heads = all_of.groupBy("name").agg(F.bool_or("user").alias("user"), F.count("*").alias("n"))
    met = shapes(all_of.withColumn("code", A.ledger_code("code")), "name").join(used, ["size", "h1", "h2"], "left")
    return heads.join(met, "name").select("name", "user", "n", F.coalesce("usage", F.lit(0)).alias("usage"))
