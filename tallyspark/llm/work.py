"""Where the operators put what outlives one job: tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType


def shared_dir(spark: SparkSession) -> str:
    """A URI under `spark.checkpoint.dir`.

    Where that setting is missing: a temporary folder in local mode (driver and executors are one process then), the
    warehouse on a cluster.  The choice is kept on the context, so that `checkpoint()` works too.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
            top = "file://" + tempfile.mkdtemp(prefix="tallyspark-")
        else:
            top = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
        spark.sparkContext.setCheckpointDir(top)
    return top.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tallyspark/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write `df` once and go on from the files: lineage ends here and nothing above runs twice."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete staged tables after their last reader."""
    for df in tables:
        if hasattr(df, "staged_at"):
            jvm = df.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(df.staged_at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def swept(spark: SparkSession) -> None:
    """Let Spark's cleaner release the shuffle files of finished steps: it acts when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def fresh(columns: list[str], name: str) -> str:
    """`name`, with underscores behind it until no column has that name in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def with_column(df: DataFrame, make, name: str, kind: DataType) -> DataFrame:
    """`df` and `name`, which replaces a column of that name: `make` gets batches and yields (batch, array of new values).

    The columns go by number meanwhile, since Arrow functions cannot address every name that a column may have.
    """
    rest = [f for f in df.schema.fields if f.name != name]
    schema = StructType([*(StructField(f"c{i}", f.dataType) for i, f in enumerate(rest)), StructField("new", kind)])

    def added(batches):
        for batch, new in make(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, new], [*batch.schema.names, "new"])

    return df.select(*[quoted(f.name).alias(f"c{i}") for i, f in enumerate(rest)]).mapInArrow(added, schema).toDF(*[f.name for f in rest], name)


def numbered(docs: DataFrame, name: str = "uid") -> DataFrame:
    """`docs` with a number for each row, written with it: counted anew, it would follow the file splits, which Spark sizes by
    the executors that are there at each reading."""
    return staged(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a few numbers that may be sent to every task; beyond it a shuffle takes the place of the broadcast.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """`df` (staged rows of a few numbers), to be broadcast if it has `limit` rows at most: their number is counted."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def light(df: DataFrame, lists: Column, limit: int = BROADCAST_ROWS) -> DataFrame:
    """`df` (staged), to be broadcast if its rows and the entries of their `lists` (a count in each row) come to `limit` at most."""
    return F.broadcast(df) if (df.agg(F.sum(lists + 4)).first()[0] or 0) <= limit else df


def row_key() -> list:
    """What tells rows of documents apart: two rows of one key are alike in doc_id and text."""
    return [F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_text"), F.length("text").alias("_length")]


def lowered(text):
    """A to Z in lower case; null is empty."""
    text = F.coalesce(text, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))
