"""Catalog of contigs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contig_catalog(aln: DataFrame, min_reads: int = 1, names: tuple[str, ...] = ("all",)) -> DataFrame:
    """(contig_idx, region, num_reads) of contigs with enough reads; index in order of name.

    A file's header gives the order where there is one; pass its names with ``header_order``.
    """
    d = aln if "all" in names else aln.where(F.col("region").isin(*names))
    d = d.where("region IS NOT NULL").groupBy("region").agg(F.count("*").alias("num_reads")).where(F.col("num_reads") >= min_reads)
    return d.select((F.row_number().over(Window.orderBy("region")) - 1).cast("int").alias("contig_idx"), "region", "num_reads")


def header_order(catalog: DataFrame, names: list[str]) -> DataFrame:
    """The catalog with the index of each contig in a header; contigs that it lacks come after, by name."""
    places = catalog.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], "region string, place int")
    own = F.row_number().over(Window.orderBy(F.col("place").isNull(), "place", "region")) - 1
    return catalog.join(places, "region", "left").select(F.coalesce("place", own + len(names)).cast("int").alias("contig_idx"), "region", "num_reads")


def largest_first(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy(F.desc("num_reads"), "contig_idx")
