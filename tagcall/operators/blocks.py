"""Blocks of reads: gap islands by position, depth by sweep line, and their filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import saved

#: A read opens a new block if it starts so far behind all ends before it, or farther.
GAP = 10
#: Positions of a region that one window task handles, and of a bin in which reads meet their blocks.
BIN, MEET = 1 << 20, 1 << 10
#: A bin is deep if it holds more than one in so many of all reads, so there are no more deep ones than this.
DEEP = 1000


def islands(spans: DataFrame, key: str = "region", start: str = "start", end: str = "end", gap: int = GAP, bin_width: int = BIN) -> DataFrame:
    """Distinct (key, start) with the number of their island within the key, and how many rows begin there.

    Rows of one start are one row first, so depth does not matter.  Windows run inside bins; only
    each bin's largest end and number of openings pass on to later bins, in a window over bins.
    """
    d = spans.groupBy(F.col(key).alias("key"), F.col(start).alias("start")).agg(F.max(end).alias("end"), F.count("*").alias("n"))
    d = saved(d.withColumn("bin", F.floor(F.col("start") / bin_width)), "starts")
    inside = Window.partitionBy("key", "bin").orderBy("start")
    d = d.withColumn("before", F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    bins = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    ends = d.groupBy("key", "bin").agg(F.max("end").alias("top")).withColumn("carried", F.max("top").over(bins)).drop("top")
    d = d.join(ends, ["key", "bin"])
    reach = F.greatest("before", "carried")
    d = d.withColumn("opens", F.when(reach.isNull() | (F.col("start") >= reach + gap), 1).otherwise(0))
    opened = d.groupBy("key", "bin").agg(F.sum("opens").alias("n")).withColumn("earlier", F.coalesce(F.sum("n").over(bins), F.lit(0))).drop("n")
    number = F.sum("opens").over(inside) + F.col("earlier")
    return d.join(opened, ["key", "bin"]).select(F.col("key").alias(key), F.col("start").alias(start), number.cast("long").alias("block_id"), d["n"])


def with_blocks(reads: DataFrame) -> DataFrame:
    """Reads with their block_id, numbered along each region.

    Reads meet the blocks that have starts in their bin.  The few bins that hold a good share of all
    reads, as where very many begin at one position, are dealt to several tasks by the reads' hash.
    """
    own_bin = F.floor(F.col("start") / MEET).alias("bin")
    starts = saved(islands(reads), "islands")
    spans = starts.groupBy("region", own_bin, "block_id").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    depth_of = starts.groupBy("region", own_bin).agg(F.sum("n").alias("depth"))
    total = starts.agg(F.sum("n").alias("total"))
    deep = depth_of.crossJoin(F.broadcast(total)).where(F.col("depth") * DEEP > F.col("total"))  # one row
    deep = F.broadcast(saved(deep.select("region", "bin", F.ceil(F.col("depth") * DEEP / F.col("total")).cast("int").alias("parts")), "deep-bins"))  # fewer than DEEP rows
    last = F.coalesce("parts", F.lit(1)) - 1
    spans = spans.join(deep, ["region", "bin"], "left").select("region", "bin", F.explode(F.sequence(F.lit(0), last)).alias("part"), "first", "last", "block_id")
    dealt = reads.withColumn("bin", own_bin).join(deep, ["region", "bin"], "left").withColumn("part", F.pmod(F.xxhash64(*reads.columns), F.lit(1).cast("long") + last).cast("int")).drop("parts")
    met = dealt.join(spans, ["region", "bin", "part"]).where(F.col("start").between(F.col("first"), F.col("last")))
    return met.select(*reads.columns, "block_id")


def depth(reads: DataFrame, keys: list[str], bin_width: int = BIN) -> DataFrame:
    """(keys, start, end, length, n_reads, max_depth) by a sweep line over read ends.

    The line runs inside bins; one row a bin, with its net change and its highest point, passes on.
    """
    edges = reads.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    steps = edges.groupBy(*keys, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d"), F.sum(F.when(F.col("e.d") > 0, 1).otherwise(0)).alias("n"))
    steps = steps.withColumn("bin", F.floor(F.col("at") / bin_width))
    line = F.sum("d").over(Window.partitionBy(*keys, "bin").orderBy("at"))
    bins = steps.withColumn("depth", line).groupBy(*keys, "bin").agg(F.min("at").alias("start"), F.max("at").alias("end"), F.sum("n").alias("n_reads"), F.max("depth").alias("top"), F.sum("d").alias("net"))
    before = F.coalesce(F.sum("net").over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = bins.withColumn("depth", F.col("top") + before).groupBy(*keys).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_reads").alias("n_reads"), F.max("depth").alias("max_depth"))
    return out.select(*keys, "start", "end", (F.col("end") - F.col("start")).alias("length"), "n_reads", "max_depth")


def valid(groups: DataFrame, coverage: int) -> DataFrame:
    """Blocks or alleles of enough reads whose depth is enough somewhere."""
    return groups.where((F.col("n_reads") >= coverage) & (F.col("max_depth") >= coverage))
