"""Sources and sinks: chart CSV, JSON catalogues, statements, inbound documents, text and XML exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.money import kurus
from tallyspark.operators import ledger


def read_chart(spark: SparkSession, path: str) -> DataFrame:
    """`code,name` with a header line; names may hold commas; codes that begin with no class of the chart are left out."""
    line = F.split("value", ",", 2)
    rows = spark.read.text(path).select(F.trim(line[0]).alias("code"), F.trim(line[1]).alias("name"))
    return rows.where(F.col("code").rlike(r"^[1-79][0-9]*(\.[0-9]+)*$"))


def read_catalogue(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document or array; rows that do not parse are null."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="PERMISSIVE")


def statement_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`rows` (date as dd.mm.yyyy or ISO, text, amount) to movements, and the rows in quarantine whose date or amount is bad."""
    date = F.coalesce(F.try_to_timestamp("date", F.lit("dd.MM.yyyy")), F.try_to_timestamp("date", F.lit("yyyy-MM-dd"))).cast("date")
    read = rows.withColumn("_date", date).withColumn("_kr", kurus(F.col("amount").try_cast("double")))
    good = F.col("_date").isNotNull() & F.col("_kr").isNotNull() & (F.col("_kr") != 0)
    moves = read.where(good).select(F.col("_date").alias("date"), "text", F.abs("_kr").alias("amount_kr"), F.when(F.col("_kr") > 0, "GIRIS").otherwise("CIKIS").alias("direction"))
    return moves, read.where(~F.coalesce(good, F.lit(False))).select(*rows.columns)


def new_documents(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Inbound documents (no, ...) that are not registered yet, once each."""
    return incoming.dropDuplicates(["no"]).join(known.select("no"), "no", "left_anti")


def movements_between(movements: DataFrame, account, since: str, until: str) -> DataFrame:
    return movements.where((F.col("account") == account) & F.col("date").between(F.lit(since).cast("date"), F.lit(until).cast("date")))


def write_ledger_text(journal: DataFrame, path: str) -> None:
    """The general ledger as fixed-width text, in order over the files."""
    ledger.text_lines(journal).repartitionByRange("account", "date", "voucher", "line_no").sortWithinPartitions("account", "date", "voucher", "line_no").select("value").write.text(path)


def invoice_xml(invoices: DataFrame) -> DataFrame:
    """Each invoice as an XML element."""
    body = F.struct(F.col("no").alias("ID"), F.col("date").alias("IssueDate"), F.col("party").alias("CustomerParty"), F.col("net_kr").alias("TaxExclusiveAmount"), F.col("vat_kr").alias("TaxAmount"), F.col("gross_kr").alias("PayableAmount"))
    return invoices.select("no", F.to_xml(body, {"rowTag": "Invoice"}).alias("xml"))


def decoded(column: str):
    """Base64 to bytes; null if it is none."""
    return F.call_function("try_to_binary", F.col(column), F.lit("base64"))
