"""Gap-island blocks over a stream of reads in order of position.

Position plays the part of time: a start is that many seconds after the epoch, so a session window
whose gap follows the read's length is a block, and the watermark says how far reads may be late.
Session windows join at equality, so the gap is one less than that of the batch form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import GAP


def stream_blocks(reads: DataFrame, late: int = 1000) -> DataFrame:
    """(region, start, end, n_reads) of finished blocks; reads has region, start, end."""
    d = reads.withColumn("at", F.timestamp_seconds("start")).withWatermark("at", f"{late} seconds")
    gap = F.concat((F.col("end") - F.col("start") + (GAP - 1)).cast("string"), F.lit(" seconds"))
    g = d.groupBy("region", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n_reads"), F.min("start").alias("start"), F.max("end").alias("end"))
    return g.select("region", "start", "end", "n_reads")
