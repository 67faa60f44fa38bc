"""Consensus rows as text: one line for each variant position, and for each insertion of an allele."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import PRINTED


def rows(consensus: DataFrame, contigs: DataFrame) -> DataFrame:
    """(contig_idx, region, block_id, pos, is_insertion, pool_allele, ref, ref_alleles, alt_alleles, n_alleles, bases, phreds, mapqs)."""
    pool = F.when(F.col("is_insertion"), F.col("allele_id")).otherwise(0)
    counts = F.struct(*(F.col(f"n_{b}").alias(b) for b in PRINTED))
    phreds = F.struct(*(F.col(f"avg_{b}").alias(b) for b in PRINTED))
    one = F.struct("allele_id", "insertion_index", "base", "is_conclusive", "ref_base", counts.alias("n"), phreds.alias("q"), "avg_mapq")
    d = consensus.groupBy("region", "block_id", "pos", "is_insertion", pool.alias("pool_allele")).agg(F.array_sort(F.collect_list(one)).alias("pool"), F.first("ref_base").alias("ref"))

    def tuples(kind: str) -> Column:
        return F.array_join(F.transform("pool", lambda c: F.format_string("(%d,%d,%d,%d,%d,%d;%d)", *(c[kind][b] for b in PRINTED), c["allele_id"])), ",")

    def letters(same: bool) -> Column:
        own = F.filter("pool", lambda c: (c["base"] == c["ref_base"]) == same)
        text = F.array_join(F.transform(own, lambda c: F.when(c["is_conclusive"], c["base"]).otherwise(F.lower(c["base"]))), ",")
        return F.when(text == "", ".").otherwise(text)

    d = d.join(contigs.select("region", "contig_idx"), "region")
    return d.select(
        "contig_idx", "region", "block_id", "pos", "is_insertion", "pool_allele", "ref", letters(True).alias("ref_alleles"), letters(False).alias("alt_alleles"),
        F.size("pool").alias("n_alleles"), tuples("n").alias("bases"), tuples("q").alias("phreds"),
        F.array_join(F.transform("pool", lambda c: F.format_string("(%d;%d)", c["avg_mapq"], c["allele_id"])), ",").alias("mapqs"),
    )


def lines(variant_rows: DataFrame) -> DataFrame:
    """(contig_idx, block_id, pos, is_insertion, pool_allele, line); the first five are the order."""
    text = F.concat(F.lit("TMPVARCALL "), F.concat_ws("\t", "region", F.col("pos").cast("string"), "ref", "ref_alleles", "alt_alleles", F.col("n_alleles").cast("string"), "bases", "phreds", "mapqs"))
    return variant_rows.select("contig_idx", "block_id", "pos", "is_insertion", "pool_allele", text.alias("line"))


def write_text(variant_rows: DataFrame, path: str) -> None:
    """Lines in order of contig, block and position, range-partitioned for the sort."""
    lines(variant_rows).orderBy("contig_idx", "block_id", "pos", "is_insertion", "pool_allele").select("line").write.text(path)
