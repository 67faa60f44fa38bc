"""SAM text as alignments; header lines are skipped by a filter, so files split freely."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """(qname, region, pos, mapq, flag, cigar, seq, qual); pos is 0-based, unplaced reads have a null region."""
    f = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.col("value").startswith("@") & (F.length("value") > 0))
    return lines.select(
        f[0].alias("qname"), F.nullif(f[2], F.lit("*")).alias("region"), (f[3].cast("long") - 1).alias("pos"), f[4].cast("long").alias("mapq"),
        f[1].cast("long").alias("flag"), f[5].alias("cigar"), F.upper(f[9]).alias("seq"), f[10].alias("qual"),
    )


def header_contigs(spark: SparkSession, path: str) -> list[str]:
    """Contig names in header order; a header is small."""
    rows = spark.read.text(path).where(F.col("value").startswith("@SQ")).select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("name"), F.monotonically_increasing_id().alias("i"))
    return [r["name"] for r in rows.orderBy("i").collect()]


def write_sam(alignments: DataFrame, path: str) -> None:
    """Alignments as SAM lines without a header."""
    c = F.col
    line = F.concat_ws("\t", c("qname"), c("flag").cast("string"), F.coalesce("region", F.lit("*")), (c("pos") + 1).cast("string"), c("mapq").cast("string"), c("cigar"), F.lit("*"), F.lit("0"), F.lit("0"), c("seq"), c("qual"))
    alignments.select(line.alias("value")).write.text(path)
