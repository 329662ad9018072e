"""Where written steps go: tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


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


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write `df` once and go on from the files: nothing above runs twice, and a lost executor costs no more than one step."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def version(spark: SparkSession, path: str) -> tuple:
    """Bytes, files and last change of what lies under `path`: another value where the input is another."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    seen = fs.getContentSummary(at)
    return seen.getLength(), seen.getFileCount(), max((s.getModificationTime() for s in fs.listStatus(at)), default=0)
