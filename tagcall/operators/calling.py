"""Votes, variant positions and consensus of substitutions, deletions and insertions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as x
from .reference import letter_at, stretch_of, stretches

ALLELE = ["region", "block_id", "allele_id"]
_LETTERS = x.PRINTED


def with_reference(votes: DataFrame, reference: DataFrame) -> DataFrame:
    """Adds ref_base and deviations to votes with coverage and counts by letter; positions without a reference letter go."""
    d = votes.withColumn("stretch", stretch_of(F.col("pos"))).join(stretches(reference), ["region", "stretch"])
    d = d.withColumn("ref_base", letter_at(F.col("pos"))).drop("stretch", "letters").where("ref_base IS NOT NULL")
    same = reduce(lambda rest, b: F.when(F.col("ref_base") == b, F.col(f"n_{b}")).otherwise(rest), _LETTERS, F.lit(0))
    return d.withColumn("deviations", F.col("cov") - same)


def allele_variants(votes: DataFrame, coverage: int, threshold: float) -> DataFrame:
    """Positions of alleles that differ from the reference beyond noise."""
    d = F.col("deviations")
    return votes.where((d > 0) & (F.col("cov") >= coverage) & x.below_share(F.col("cov") - d, threshold, F.col("cov")))


def variant_positions(votes: DataFrame, coverage: int, threshold: float) -> DataFrame:
    return allele_variants(votes, coverage, threshold).select("region", "block_id", "pos").distinct()


def at_variants(votes: DataFrame, positions: DataFrame, coverage: int) -> DataFrame:
    """Votes of every covered allele at the variant positions, also of those that match the reference."""
    return votes.where(F.col("cov") >= coverage).join(positions, ["region", "block_id", "pos"], "left_semi")


def majority(counts: dict[str, Column]) -> tuple[Column, Column, Column]:
    """(letter, ambiguous, largest count) from column ``most``; a tie at the largest count gives N and is ambiguous."""
    most = F.col("most")
    ties = sum(F.when(c == most, 1).otherwise(0) for c in counts.values())
    letter = F.coalesce(*(F.when(c == most, b) for b, c in counts.items()))
    return F.when(ties > 1, "N").otherwise(letter), ties > 1, most


def consensus(votes: DataFrame, threshold: float) -> DataFrame:
    """Adds base, is_ambiguous, is_conclusive and truncated averages to rows of votes."""
    base, ambiguous, most = majority({b: F.col(f"n_{b}") for b in _LETTERS})
    d = votes.withColumn("most", F.greatest(*(F.col(f"n_{b}") for b in _LETTERS))).withColumns({"base": base, "is_ambiguous": ambiguous})
    d = d.withColumn("is_conclusive", ~F.col("is_ambiguous") & ~x.below_share(F.col("most"), threshold, F.col("cov")))
    average = lambda total, n: F.when(n == 0, 0).otherwise(F.call_function("div", total, n))
    return d.withColumns({f"avg_{b}": average(F.col(f"q_{b}"), F.col(f"n_{b}")).cast("long") for b in _LETTERS} | {"avg_mapq": average(F.col("mapq_sum"), F.col("cov")).cast("long")}).drop("most")


_ROW = ["region", "block_id", "allele_id", "pos", "is_insertion", "insertion_index", "ref_base", "base", "cov", "is_conclusive", "is_ambiguous", *(f"n_{b}" for b in _LETTERS), *(f"avg_{b}" for b in _LETTERS), "avg_mapq"]


def substitutions(votes: DataFrame, positions: DataFrame, coverage: int, threshold: float) -> DataFrame:
    rows = consensus(at_variants(votes, positions, coverage), threshold)
    return rows.withColumns({"is_insertion": F.lit(False), "insertion_index": F.lit(0)}).select(*_ROW)


def insertion_support(inserted: DataFrame, votes: DataFrame, coverage: int) -> DataFrame:
    """Insertions at covered positions, with coverage and mapq sum there; none outside the allele."""
    return inserted.join(votes.where(F.col("cov") >= coverage).select(*ALLELE, "pos", "cov", "mapq_sum"), [*ALLELE, "pos"])


def insertion_sites(support: DataFrame, threshold: float) -> DataFrame:
    """Positions where insertions are more than noise: (allele, pos, cov, mapq_sum, n_ins)."""
    sites = support.groupBy(*ALLELE, "pos").agg(F.count("*").alias("n_ins"), F.max("cov").alias("cov"), F.max("mapq_sum").alias("mapq_sum"))
    n = F.col("n_ins")
    return sites.where((n <= F.col("cov")) & x.below_share(F.col("cov") - n, threshold, F.col("cov")))


def insertion_consensus(support: DataFrame, threshold: float) -> DataFrame:
    """Consensus of each inserted letter, up to the first that most reads do not have."""
    sites = insertion_sites(support, threshold)
    letters = support.select(*ALLELE, "pos", F.posexplode(F.arrays_zip("bases", "phreds")).alias("insertion_index", "v"))
    base, phred = F.col("v.bases"), F.col("v.phreds")
    real = [b for b in _LETTERS if b != "D"]
    votes = letters.groupBy(*ALLELE, "pos", "insertion_index").agg(F.count("*").alias("have"), *(F.count_if(base == b).alias(f"n_{b}") for b in real), *(F.sum(F.when(base == b, phred).otherwise(0)).alias(f"q_{b}") for b in real))
    votes = votes.join(sites, [*ALLELE, "pos"])
    lacking = F.col("cov") - F.col("have")
    rows = consensus(votes.withColumns({"n_D": lacking, "q_D": lacking * x.DELETED_PHRED}), threshold)
    order = Window.partitionBy(*ALLELE, "pos").orderBy("insertion_index")
    rows = rows.withColumn("ended", F.max(F.when(F.col("base") == "D", 1).otherwise(0)).over(order)).where("ended = 0")
    return rows.withColumns({"is_insertion": F.lit(True), "ref_base": F.lit("D")}).select(*_ROW)
