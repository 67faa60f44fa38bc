"""Counters, five-number summaries, histograms, report text and fingerprint of a run."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import percent
from ..tables import saved
from .cluster import BLOCK, pair_counts

#: Alleles at a position that have a bucket of their own; more go to bucket 0.
BUCKETS = 10
TOP_TAGS = 11
#: Seed of the fingerprint and the zeros before its counters.
CRC_SEED, CRC_ZEROS = 0x12345678, 1000


def summary(values: DataFrame, column: str) -> DataFrame:
    """n, min, q1, q2, q3, max, sum, mean, stddev, stderr, var of whole numbers; zeros if there are none.

    q_k is the value at rank floor(k n / 4) from 0; variance is the population's.  Counts of distinct
    values are dealt by range; ranks add up inside a part, and one array with a number for each part
    says how many values lie before it.
    """
    v = values.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("long").alias("v")).agg(F.count("*").alias("c"))
    v = saved(v.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "value-counts")
    parts = v.groupBy("part").agg(F.sum("c").alias("c")).agg(F.collect_list(F.struct("part", "c")).alias("parts"))
    before = lambda p: F.aggregate("parts", F.lit(0).cast("long"), lambda s, x: s + F.when(x["part"] < p, x["c"]).otherwise(0))
    d = v.withColumn("top", F.sum("c").over(Window.partitionBy("part").orderBy("v"))).crossJoin(F.broadcast(parts))  # one row
    d = d.withColumns({"top": F.col("top") + before(F.col("part")), "n": before(F.lit(1 << 30))})

    def quartile(k: int) -> Column:
        return F.min(F.when(F.col("top") > F.floor(k * F.col("n") / 4), F.col("v")))

    s, ss, n = F.sum(F.col("v") * F.col("c")), F.sum((F.col("v") * F.col("v") * F.col("c")).cast("double")), F.sum("c")
    d = d.agg(n.alias("n"), F.min("v").alias("min"), quartile(1).alias("q1"), quartile(2).alias("q2"), quartile(3).alias("q3"), F.max("v").alias("max"), s.alias("sum"), ss.alias("ss"))
    mean = F.col("sum") / F.col("n")
    d = d.withColumn("mean", mean).withColumn("var", F.greatest(F.col("ss") / F.col("n") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    d = d.withColumn("stddev", F.sqrt("var")).withColumn("stderr", F.col("stddev") / F.sqrt("n"))
    whole, real = ("n", "min", "q1", "q2", "q3", "max", "sum"), ("mean", "stddev", "stderr", "var")
    return d.select(*(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in whole), *(F.round(F.coalesce(F.col(c), F.lit(0.0)), 6).alias(c) for c in real))


def block_counters(blocks: DataFrame, valid: DataFrame) -> DataFrame:
    a = blocks.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("n_reads"), F.lit(0)).alias("reads_in_blocks"))
    b = valid.agg(F.count("*").alias("valid_blocks"), F.coalesce(F.sum("n_reads"), F.lit(0)).alias("reads_in_valid_blocks"), F.coalesce(F.sum("length"), F.lit(0)).alias("valid_length"))
    return a.crossJoin(b)  # one row each


def cluster_counters(tags: DataFrame, alleles: DataFrame, distance: int, mode: str = "dbscan") -> DataFrame:
    """Distances in all and after the bound, tags before and alleles after, reads before and after."""
    pairs = pair_counts(tags, distance)
    off = F.lit(mode != "none").cast("long")
    pairs = pairs.select((F.col("total") * off).alias("leven_total"), (F.col("complete") * off).alias("leven_complete"))
    before = tags.agg(F.count("*").alias("tags_before"), F.coalesce(F.sum("n_reads"), F.lit(0)).alias("reads_before"))
    after = alleles.agg(F.count("*").alias("alleles_after"), F.coalesce(F.sum("n_reads"), F.lit(0)).alias("reads_after"), F.count_distinct(*BLOCK).alias("blocks_after"))
    return pairs.crossJoin(before).crossJoin(after)


def consensus_counters(consensus: DataFrame) -> DataFrame:
    ins, deleted = F.col("is_insertion"), ~F.col("is_insertion") & (F.col("base") == "D")
    yes, tie = F.col("is_conclusive"), F.col("is_ambiguous")
    return consensus.agg(
        F.count("*").alias("total"), F.count_if(yes).alias("conclusive"), F.count_if(tie).alias("ambiguous"),
        F.count_if(ins).alias("total_ins"), F.count_if(ins & yes).alias("conclusive_ins"), F.count_if(ins & tie).alias("ambiguous_ins"),
        F.count_if(deleted).alias("total_del"), F.count_if(deleted & yes).alias("conclusive_del"), F.count_if(deleted & ~yes).alias("inconclusive_del"),
    )


def derived_counters(c: DataFrame) -> DataFrame:
    """What the report subtracts from the counters, with shares of the total."""
    col = F.col
    d = c.withColumns({
        "inconclusive": col("total") - col("conclusive") - col("ambiguous"),
        "inconclusive_ins": col("total_ins") - col("conclusive_ins") - col("ambiguous_ins"),
        "total_snp": col("total") - col("total_ins") - col("total_del"),
        "conclusive_snp": col("conclusive") - col("conclusive_ins") - col("conclusive_del"),
        "ambiguous_snp": col("ambiguous") - col("ambiguous_ins"),
    })
    d = d.withColumn("inconclusive_snp", col("total_snp") - col("conclusive_snp") - col("ambiguous_snp"))
    return d.withColumns({f"{x}_pct": percent(col(x), col("total")) for x in ("conclusive", "inconclusive", "ambiguous", "total_snp", "total_ins", "total_del")})


def histogram(counts: DataFrame, column: str) -> DataFrame:
    """(bucket, n): how often each number up to BUCKETS occurs; larger ones in bucket 0."""
    bucket = F.when(F.col(column) > BUCKETS, 0).otherwise(F.col(column)).cast("int")
    return counts.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def dropout(counts: DataFrame, column: str) -> DataFrame:
    """Positions with one, two, three or more alleles, and the share of the first."""
    n = F.col(column)
    d = counts.agg(F.count("*").alias("positions"), F.count_if(n == 1).alias("one_allele"), F.count_if(n == 2).alias("two_alleles"), F.count_if(n >= 3).alias("more_alleles"))
    return d.withColumn("dropout_pct", percent(F.col("one_allele"), F.col("positions")))


def region_blocks(contigs: DataFrame, valid: DataFrame) -> DataFrame:
    """Surviving blocks of each contig, also of those without any, in header order of contig_idx."""
    n = valid.groupBy("region").agg(F.count("*").alias("n"))
    d = contigs.join(n, "region", "left").select("contig_idx", "region", F.coalesce("n", F.lit(0)).alias("blocks"))
    return d.withColumn("pct", percent(F.col("blocks"), F.sum("blocks").over(Window.partitionBy())))


def top_tags(clusters: DataFrame, limit: int = TOP_TAGS) -> DataFrame:
    d = clusters.groupBy("tag16", "tag_key").agg(F.sum("n_reads").alias("n"))
    return d.orderBy(F.desc("n"), "tag_key").limit(limit).select("tag16", "n")


def counters(run) -> dict[str, int]:
    """All counters of a ``Caller`` run; a few one-row aggregations."""
    p = run.params
    out = block_counters(run.blocks, run.valid_blocks).first().asDict()
    out |= cluster_counters(run.tags, run.alleles, p.distance, p.cluster).first().asDict()
    out |= consensus_counters(run.consensus).first().asDict()
    survivors = run.alleles.select(*BLOCK).distinct()
    out["reference_bases"] = run.valid_blocks.join(survivors, BLOCK, "left_semi").agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    out["positions_tested"] = run.alleles_at.count()
    out["positions_with_variants"] = run.positions.count()
    out["reads_in_file"] = run.alignments.count() if p.all_regions else run.alignments.where(F.col("region").isin(*p.regions)).count()
    return out


def fingerprint(c: dict[str, int]) -> int:
    """Seeded CRC-32 of the counters as 64-bit integers after a run of zeros; counters never kept are 0."""
    values = [
        0, 0, c["valid_blocks"], c["reads_in_file"], 0, c["reads_in_valid_blocks"], 0, c["tags_before"], c["alleles_after"],
        c["reference_bases"], c["positions_tested"], c["positions_with_variants"], c["leven_complete"], c["leven_total"],
        c["total"], c["conclusive"], c["ambiguous"], c["blocks_after"], c["total_ins"], c["conclusive_ins"], c["ambiguous_ins"],
        c["total_del"], c["conclusive_del"], c["inconclusive_del"],
    ]
    return zlib.crc32(struct.pack(f"<{CRC_ZEROS + len(values)}q", *[0] * CRC_ZEROS, *values), CRC_SEED)
