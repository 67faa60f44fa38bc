"""The whole run: alignments and a reference to variant rows, every stage a DataFrame.

Stages that later ones share are written once and read back, so that no plan holds a stage twice
and a lost executor costs no more than its own tasks.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocks, calling, cigar, cluster, contigs, filters, formatting, votes
from ..params import Params
from ..tables import saved


class Caller:
    def __init__(self, alignments: DataFrame, reference: DataFrame, params: Params | None = None, header: list[str] | None = None):
        """reference: pieces (region, piece, letters) or rows (region, pos, ref_base).

        header: contig names in the order of the rows wanted, as a file's header has them; by name where there is none.
        """
        self.alignments, self.reference, self.params, self.header = alignments, reference, params or Params(), header

    @cached_property
    def contigs(self) -> DataFrame:
        found = contigs.contig_catalog(self.alignments, names=self.params.regions)
        return contigs.header_order(found, self.header) if self.header else found

    @cached_property
    def reads(self) -> DataFrame:
        """Filtered reads with tag, start and end."""
        return cigar.with_end(filters.tagged_reads(self.alignments, self.params), self.params.extended_cigar)

    @cached_property
    def reads_in_blocks(self) -> DataFrame:
        return saved(blocks.with_blocks(self.reads), "blocked-reads")

    @cached_property
    def blocks(self) -> DataFrame:
        return saved(blocks.depth(self.reads_in_blocks, cluster.BLOCK), "blocks")

    @cached_property
    def valid_blocks(self) -> DataFrame:
        return blocks.valid(self.blocks, self.params.coverage)

    @cached_property
    def valid_reads(self) -> DataFrame:
        return self.reads_in_blocks.join(self.valid_blocks.select(*cluster.BLOCK), cluster.BLOCK, "left_semi")

    @cached_property
    def tags(self) -> DataFrame:
        return saved(cluster.tag_groups(self.valid_reads), "tags")

    @cached_property
    def clusters(self) -> DataFrame:
        return saved(cluster.clustered(self.tags, self.params.cluster, self.params.distance), "clusters")

    @cached_property
    def clustered_reads(self) -> DataFrame:
        return cluster.allele_reads(self.valid_reads, self.clusters)

    @cached_property
    def alleles(self) -> DataFrame:
        return saved(cluster.alleles(self.clustered_reads, self.params.coverage), "alleles")

    @cached_property
    def allele_reads(self) -> DataFrame:
        """Reads of alleles that are kept, with allele_id."""
        return saved(self.clustered_reads.join(self.alleles.select(*cluster.BLOCK, "allele_key", "allele_id"), [*cluster.BLOCK, "allele_key"]), "allele-reads")

    @cached_property
    def votes(self) -> DataFrame:
        return saved(calling.with_reference(votes.base_votes(self.allele_reads, self.params.phred, calling.ALLELE), self.reference), "votes")

    @cached_property
    def positions(self) -> DataFrame:
        return calling.variant_positions(self.votes, self.params.coverage, self.params.threshold)

    @cached_property
    def support(self) -> DataFrame:
        inserted = cigar.insertions(self.allele_reads, self.params.phred, calling.ALLELE)
        return saved(calling.insertion_support(inserted, self.votes, self.params.coverage), "insertions")

    @cached_property
    def consensus(self) -> DataFrame:
        p = self.params
        found = calling.substitutions(self.votes, self.positions, p.coverage, p.threshold)
        return saved(found.unionByName(calling.insertion_consensus(self.support, p.threshold)), "consensus")

    @cached_property
    def rows(self) -> DataFrame:
        return formatting.rows(self.consensus, self.contigs)

    @cached_property
    def alleles_at(self) -> DataFrame:
        """(region, block_id, pos, n_alleles): covered alleles at each position that has any."""
        return self.votes.where(F.col("cov") >= self.params.coverage).groupBy(*cluster.BLOCK, "pos").agg(F.count("*").alias("n_alleles"))
