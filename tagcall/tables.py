"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder and all its workers are on this machine, as in tests.
FALLBACK_DIR = "/tmp/checkpoints"


def folder(spark: SparkSession, name: str) -> str:
    """A new place in the folder that all executors and the driver share."""
    root, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not root and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(root or FALLBACK_DIR).rstrip('/')}/tagcall/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def drop(df: DataFrame) -> None:
    """Delete what ``saved`` wrote for a table that nothing reads any more."""
    spark, path = df.sparkSession, df._written_at
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
