"""Session helpers shared by the operators: input tables, shared tables, safe broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and all its workers are on this machine, as in tests.
FALLBACK_DIR = "/tmp/checkpoints"
#: A join side is broadcast up to this many bytes (rows counted first, times a row's width).
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (own or FALLBACK_DIR).rstrip("/")


#: Rows that a task of a step with a known number of rows handles, at most.
TASK_ROWS = 50_000
#: Lets Spark delete a query's shuffle files as soon as its table is written.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str, rows: int | None = None, per_task: int = TASK_ROWS) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    ``rows``: at most so many rows go into the last step, so no more tasks than they need run it and
    write; their number grows with the rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tagcall/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(rows // per_task + 1)
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch to Python workers; long texts would make larger ones heavy.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table; from here on the session hands Python workers small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """Hint a broadcast only when the counted rows fit the bound; else the join shuffles.

    ``df`` should be a saved table, as it is counted here.
    """
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


#: A key is hot if it holds more than one in so many rows, and more than ``DEAL`` of them.
HOT = 1000
DEAL = 1000


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key, salts): the fewer than HOT hot keys of a saved table, and over how many tasks to deal the rows of each."""
    each = max(rows.count() / HOT, DEAL)
    return rows.groupBy(key).agg(F.ceil(F.count("*") / each).cast("int").alias("salts")).where("salts > 1")


def salted_join(rows: DataFrame, side: DataFrame, key: str, by: str, hot: DataFrame) -> DataFrame:
    """Inner join on ``key``, unique in ``side``: rows of a hot key are dealt by column ``by``.

    Fewer than 2 * HOT rows of ``side`` are repeated for that, whatever the size.
    """
    hot = F.broadcast(hot)  # fewer than HOT rows
    salts = F.coalesce("salts", F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn("salt", F.pmod(F.xxhash64(by), salts).cast("int")).drop("salts")
    ready = side.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return dealt.join(ready, [key, "salt"]).drop("salt")


def crc_mod(column: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % mod, F.lit(0))


def free_names(df: DataFrame, n: int) -> list[str]:
    """Names that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    return [c for c in (f"own_{i}" for i in range(len(taken) + n)) if c not in taken][:n]
