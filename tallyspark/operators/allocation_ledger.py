"""The ledger of allocations: what is booked stays, what no longer holds is reversed, what is new gets the next number.

An allocation is known by its key, receipt|invoice|amount.  A sync compares the keys that should be with those that are active: each one missing gets
a voucher, each one too many is closed by a reversal, and both stay in the ledger.  So a sync that is repeated changes nothing.
`AllocationLedger` keeps the ledger as versions; a version counts once all of it is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators.desk import allocation_lines
from tallyspark.operators.running import ranged, running
from tallyspark.sources.scratch import written

SCHEMA = "serial long, key string, voucher_no string, id long, no long, amount_kr long, source string, state string, counter string, reversal boolean"
ACTIVE = "state = 'AKTIF' and not reversal"


def key() -> Column:
    return F.concat_ws("|", "id", "no", "amount_kr")


def wanted(allocated: DataFrame) -> DataFrame:
    """`allocated` (id, no, amount_kr, source) as the ledger knows them: by hand (MANUEL) or not (OTOMATIK), each key once."""
    source = F.when(F.col("source") == "MANUEL", "MANUEL").otherwise("OTOMATIK")
    return allocated.groupBy("id", "no", "amount_kr").agg(F.min(source).alias("source")).withColumn("key", key())


def changes(ledger: DataFrame, should: DataFrame) -> DataFrame:
    """What a sync does to `ledger`, with the serial numbers it takes: reversals in the order of their vouchers, then new vouchers in the order of their keys.

    Columns: serial, reversal, of (the serial that is reversed), voucher (its number), key, id, no, amount_kr, source.
    """
    active = ledger.where(ACTIVE)
    last = ledger.agg(F.max("serial")).first()[0] or 0
    own = ["key", "id", "no", "amount_kr", "source"]
    gone = active.join(should.select("key"), "key", "left_anti").select(F.lit(True).alias("reversal"), F.col("serial").alias("of"), F.col("voucher_no").alias("voucher"), *own)
    new = should.join(active.select("key"), "key", "left_anti").select(F.lit(False).alias("reversal"), F.lit(0).cast("long").alias("of"), F.lit(None).cast("string").alias("voucher"), *own)
    rows = gone.unionByName(new).withColumn("turn", F.when(F.col("reversal"), 0).otherwise(1)).withColumn("all", F.lit(0))
    order = ["turn", "of", "key"]
    found = running(ranged(rows, ["all"], order), ["all"], order, {"n": (F.sum, F.lit(1))})
    return found.select((F.lit(last) + F.col("n")).alias("serial"), "reversal", "of", "voucher", *own)


def applied(ledger: DataFrame, change: DataFrame) -> DataFrame:
    """`ledger` after `change` (written)."""
    number = lambda form: F.format_string(form, F.col("serial"))
    back = change.where("reversal").select("of", number("STR-%06d").alias("by"))
    old = ledger.join(back, ledger["serial"] == back["of"], "left")
    closed = F.col("by").isNotNull()
    old = old.select("serial", "key", "voucher_no", "id", "no", "amount_kr", "source", F.when(closed, "IPTAL").otherwise(F.col("state")).alias("state"), F.coalesce("by", "counter").alias("counter"), "reversal")
    row = lambda k, voucher, counter: [F.col("serial"), k.alias("key"), voucher.alias("voucher_no"), *map(F.col, ("id", "no", "amount_kr", "source")), F.lit("AKTIF").alias("state"), counter.alias("counter"), F.col("reversal")]
    reversals = change.where("reversal").select(*row(F.concat(F.lit("STORNO|"), "key"), number("STR-%06d"), F.col("voucher")))
    new = change.where("not reversal").select(*row(F.col("key"), number("THS-F%06d"), F.lit(None).cast("string")))
    return old.unionByName(reversals).unionByName(new)


def synced(ledger: DataFrame, allocated: DataFrame) -> DataFrame:
    """`ledger` brought to what `allocated` says."""
    return applied(ledger, written(changes(ledger, wanted(allocated)), "changes"))


def frozen(ledger: DataFrame, free: DataFrame | None = None) -> DataFrame:
    """Allocations that are booked and stay (id, no, amount_kr); not those of receipts that are set `free` (id) to be allocated anew."""
    active = ledger.where(ACTIVE)
    return (active if free is None else active.join(free.select("id").distinct(), "id", "left_anti")).select("id", "no", "amount_kr")


def lines(ledger: DataFrame, money: DataFrame, direction: str = "SATIS") -> DataFrame:
    """The account lines of all vouchers: serial, voucher_no, line_no, account, debit_kr, credit_kr; a reversal has its original's with the sides changed."""
    legs = allocation_lines(ledger.select("id", "no", "amount_kr", "serial"), money, direction).select("id", "no", "line_no", "account", "debit_kr", "credit_kr").distinct()
    met = ledger.select("serial", "voucher_no", "reversal", "id", "no", "amount_kr").join(legs, ["id", "no"]).where("debit_kr + credit_kr = amount_kr")
    side = lambda a, b: F.when(F.col("reversal"), F.col(b)).otherwise(F.col(a))
    return met.select("serial", "voucher_no", "line_no", "account", side("debit_kr", "credit_kr").alias("debit_kr"), side("credit_kr", "debit_kr").alias("credit_kr"))


class AllocationLedger:
    """The ledger under `path`, a folder for each version.  A version without Spark's mark of success was never finished: it is not read, and overwritten."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def versions(self) -> list[int]:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/version=*/_SUCCESS")
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at)
        return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found or [])

    def read(self, version: int | None = None) -> DataFrame:
        """The newest ledger, or an older one; empty before the first."""
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/version={known[-1] if version is None else version}")

    def sync(self, allocated: DataFrame) -> dict[str, int]:
        """Bring the ledger to `allocated`; how many vouchers are new and how many were reversed.  Without a change no version is written."""
        known = self.versions()
        ledger = self.read()
        change = written(changes(ledger, wanted(allocated)), "changes")
        counts = change.agg(F.count_if(~F.col("reversal")).alias("new"), F.count_if("reversal").alias("reversed")).first().asDict()
        version = known[-1] if known else 0
        if counts["new"] or counts["reversed"]:
            version += 1
            applied(ledger, change).write.mode("overwrite").parquet(f"{self.path}/version={version}")
        return counts | {"version": version}
