"""One query for each operator, on alignments derived from the ``events`` table.

Tables that several queries share are made once for each session and input folder; ``forget``
drops them, as the benchmark does between queries.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import exprs as x
from .operators import blocks, calling, cigar, cluster, contigs, filters, formatting, reference, stats, votes
from .params import TAG_SLOTS
from .plans.caller import Caller
from .sources import derived, fasta
from .tables import folder, saved

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_RUNS: dict[tuple[str, str], Caller] = {}
#: Events that a task derives reads from.
DEALT_ROWS = 500_000


def forget(fixtures: bool = True) -> None:
    """Start anew; without the derived alignments and reference if they are not fixtures to keep."""
    for key, run in list(_RUNS.items()):
        _RUNS.pop(key) if fixtures else _RUNS.update({key: Caller(run.alignments, run.reference)})


def caller(spark: SparkSession, sf_dir: str) -> Caller:
    """The run over one folder's alignments, which are written as a table first."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RUNS:
        ev = derived.events(spark, sf_dir).select("event_id")
        _RUNS[key] = Caller(saved(derived.alignments(dealt(ev, "event_id")), "alignments"), saved(derived.reference(ev), "reference"))
    return _RUNS[key]


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores in order of ``key``, as reads of a file lie by position, so a batch holds whole blocks."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions(), df.count() // DEALT_ROWS)
    return df.repartitionByRange(n, key).sortWithinPartitions(key)


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT."""
    return df.select(*(df[c].cast("long").alias(c) if t in ("int", "smallint", "tinyint") else df[c] for c, t in df.dtypes))


def query(f: Callable[[Caller], DataFrame]) -> Callable[[Caller], DataFrame]:
    @wraps(f)
    def on_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(f(caller(spark, sf_dir)))

    QUERIES[f.__name__] = on_folder
    return f


def table_query(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
    QUERIES[f.__name__] = lambda spark, sf_dir: plain(f(spark, sf_dir))
    return f


_TAGS = [s.lower() for s in TAG_SLOTS]


# ---------------------------------------------------------------- scans and contigs

@query
def scan_region(c: Caller) -> DataFrame:
    return c.alignments.where(F.col("region") == "chr2").select("qname", "region", "pos", "flag", "mapq", "cigar")


@query
def contig_catalog(c: Caller) -> DataFrame:
    return contigs.contig_catalog(c.alignments)


@query
def reference_slice(c: Caller) -> DataFrame:
    return reference.slices(c.reference, c.valid_blocks)


@query
def fasta_slice(c: Caller) -> DataFrame:
    """The same slices from the reference written as FASTA with an index, of which only those contigs' pieces are read."""
    spark = c.reference.sparkSession
    path = folder(spark, "fasta") + "/reference.fa"
    fasta.write_fasta(c.reference, path)
    return reference.slices(fasta.load(spark, path).where(F.col("region").isin("chr2", "chr4")), c.valid_blocks)


# ---------------------------------------------------------------- filters and tags

@query
def filter_mapq(c: Caller) -> DataFrame:
    return c.alignments.where(F.col("mapq") >= 30).select("qname", "flag", "mapq")


@query
def filter_flags(c: Caller) -> DataFrame:
    return c.alignments.where(x.is_usable(F.col("flag"))).select("qname", "flag")


@query
def filter_strand(c: Caller) -> DataFrame:
    return c.alignments.where(x.is_forward(F.col("flag"))).select("qname", "flag")


@query
def filter_pair(c: Caller) -> DataFrame:
    return c.alignments.where(x.is_proper_pair(F.col("flag"))).select("qname", "flag")


@query
def tag_parse(c: Caller) -> DataFrame:
    return filters.with_tags(c.alignments).select("qname", *_TAGS)


@query
def orientation(c: Caller) -> DataFrame:
    return filters.with_orientation(c.alignments).select("qname", "flag", "orientation", "is_forward")


def _swapped(c: Caller) -> DataFrame:
    return filters.with_mask(filters.swap_tags(filters.with_orientation(filters.with_tags(c.alignments))))


@query
def tag_swap(c: Caller) -> DataFrame:
    return _swapped(c).select("qname", "orientation", *_TAGS)


@query
def filter_orientation(c: Caller) -> DataFrame:
    return filters.with_orientation(c.alignments).where(F.col("orientation").isin("FR", "FF")).select("qname", "orientation")


@query
def tag_mask(c: Caller) -> DataFrame:
    return _swapped(c).select("qname", "tag_mask")


@query
def tag_mask_filter(c: Caller) -> DataFrame:
    return _swapped(c).where(F.col("tag_mask").isin(*x.TAG_MASKS)).select("qname", "tag_mask")


@query
def tag_select(c: Caller) -> DataFrame:
    chosen = x.tag_select(tuple(F.col(t) for t in _TAGS), (0, 2))
    return _swapped(c).withColumn("tag", chosen).where("tag IS NOT NULL").select("qname", "tag")


@query
def tag_encode(c: Caller) -> DataFrame:
    key = F.col("tag_key")
    return c.reads.select("qname", "tag", "tag16", "tag_key", x.packed(key).alias("packed"), x.unpacked(x.packed(key)).alias("unpacked"))


@query
def base_code(c: Caller) -> DataFrame:
    code = x.base_code(F.substring("seq", 1, 1))
    return c.alignments.select("qname", code.alias("code"), x.code_base(code).alias("base"))


# ---------------------------------------------------------------- CIGAR

@query
def cigar_length(c: Caller) -> DataFrame:
    return c.reads.select("qname", "start", "length", "end")


@query
def cigar_ops(c: Caller) -> DataFrame:
    ops = c.reads.select("qname", F.explode(cigar.operations(F.col("cigar"))).alias("o"))
    return ops.select("qname", "o.*")


@query
def pileup(c: Caller) -> DataFrame:
    letters = F.explode(F.array(*(F.struct(F.lit(b).alias("base"), F.col(f"n_{b}").alias("n"), F.col(f"q_{b}").alias("phred_sum")) for b in x.PRINTED)))
    return votes.base_votes(c.reads, 0, ["region"]).select("region", "pos", letters.alias("v")).select("region", "pos", "v.*").where("n > 0")


@query
def phred_mask(c: Caller) -> DataFrame:
    every = votes.base_votes(c.reads, 30, ["region"]).groupBy("region").agg(*(F.sum(n).alias(n) for n in votes.COUNTS))
    return every.select("region", F.explode(F.array(*(F.struct(F.lit(b).alias("base"), F.col(f"n_{b}").alias("n")) for b in x.PRINTED))).alias("v")).select("region", "v.*").where("n > 0")


@query
def read_insertions(c: Caller) -> DataFrame:
    d = cigar.insertions(c.reads, 0, ["qname", "region"])
    return d.select("qname", "region", "pos", F.array_join("bases", "").alias("bases"), F.array_join(F.transform("phreds", lambda p: p.cast("string")), ",").alias("phreds"))


# ---------------------------------------------------------------- blocks

@query
def gap_islands(c: Caller) -> DataFrame:
    return c.reads_in_blocks.select("qname", "region", "start", "end", "block_id")


@query
def block_having(c: Caller) -> DataFrame:
    return c.reads_in_blocks.groupBy(*cluster.BLOCK).agg(F.count("*").alias("n_reads")).where(F.col("n_reads") >= 45)


@query
def max_depth(c: Caller) -> DataFrame:
    return c.blocks.select(*cluster.BLOCK, "max_depth")


@query
def valid_blocks(c: Caller) -> DataFrame:
    return c.valid_blocks


@query
def stats_blocks(c: Caller) -> DataFrame:
    return stats.block_counters(c.blocks, c.valid_blocks)


# ---------------------------------------------------------------- clustering

@query
def tag_groups(c: Caller) -> DataFrame:
    return c.tags


@query
def cluster_none(c: Caller) -> DataFrame:
    return cluster.clustered(c.tags, "none", 0).select(*cluster.BLOCK, "tag_key", "allele_key", "n_reads")


@query
def tag_freq(c: Caller) -> DataFrame:
    return c.tags.select("tag16", *(x.count_letter(F.col("tag16"), b).alias(f"n_{b.lower()}") for b in "NATCG")).distinct()


@query
def lev_lower_bound(c: Caller) -> DataFrame:
    return cluster.tag_pairs(c.tags).select(*cluster.BLOCK, "key_a", "key_b", "bound")


@query
def tag_edges(c: Caller) -> DataFrame:
    return cluster.tag_edges(c.tags, c.params.distance).select(*cluster.BLOCK, "key_a", "key_b", "dist")


@query
def levenshtein(c: Caller) -> DataFrame:
    d = cluster.tag_pairs(c.tags)
    return d.select(*cluster.BLOCK, "key_a", "key_b", F.levenshtein("tag_a", "tag_b").alias("dist"), F.levenshtein("tag_a", "tag_b", 2).alias("dist2"))


@query
def tag_components(c: Caller) -> DataFrame:
    return c.clusters.select(*cluster.BLOCK, "tag_key", "allele_key")


@query
def allele_tags(c: Caller) -> DataFrame:
    return c.clusters.groupBy(*cluster.BLOCK, "allele_key").agg(F.count("*").alias("n_tags"), F.sum("n_reads").alias("n_reads"))


@query
def allele_having(c: Caller) -> DataFrame:
    return c.alleles.select(*cluster.BLOCK, "allele_key", "n_reads", "max_depth")


@query
def blocks_after(c: Caller) -> DataFrame:
    return c.valid_blocks.join(c.alleles, cluster.BLOCK, "left_semi").select(*cluster.BLOCK)


@query
def stats_cluster(c: Caller) -> DataFrame:
    return stats.cluster_counters(c.tags, c.alleles, c.params.distance)


@query
def hamming(c: Caller) -> DataFrame:
    d = cluster.tag_pairs(c.tags)
    return d.select(*cluster.BLOCK, "key_a", "key_b", x.hamming(F.col("tag_a"), F.col("tag_b")).alias("dist"))


@query
def cluster_size_hist(c: Caller) -> DataFrame:
    sizes = c.clusters.groupBy(*cluster.BLOCK, "allele_key").agg(F.sum("n_reads").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("size"))


# ---------------------------------------------------------------- calling

@query
def allele_ids(c: Caller) -> DataFrame:
    return c.alleles.select(*cluster.BLOCK, "allele_key", "allele_id", "start", "end")


@query
def allele_coverage(c: Caller) -> DataFrame:
    return c.votes.select(*calling.ALLELE, "pos", "cov")


@query
def ref_join(c: Caller) -> DataFrame:
    return c.votes.select(*calling.ALLELE, "pos", "ref_base")


@query
def deviations(c: Caller) -> DataFrame:
    return c.votes.select(*calling.ALLELE, "pos", "cov", "deviations")


@query
def allele_variants(c: Caller) -> DataFrame:
    return calling.allele_variants(c.votes, c.params.coverage, c.params.threshold).select(*calling.ALLELE, "pos")


@query
def variant_positions(c: Caller) -> DataFrame:
    return c.positions


@query
def pos_x_allele(c: Caller) -> DataFrame:
    return calling.at_variants(c.votes, c.positions, c.params.coverage).select(*calling.ALLELE, "pos", "cov")


@query
def base_votes(c: Caller) -> DataFrame:
    names = [f"{k}_{b}" for k in "nq" for b in x.PRINTED]
    return c.votes.select(*calling.ALLELE, "pos", "cov", "mapq_sum", *(F.col(n).alias(n.lower()) for n in names))


def _consensus(c: Caller, kind: Column) -> DataFrame:
    names = [f"{k}_{b}" for k in ("n", "avg") for b in x.PRINTED]
    return c.consensus.where(kind).select(*calling.ALLELE, "pos", "insertion_index", "ref_base", "base", "cov", "is_conclusive", "is_ambiguous", *(F.col(n).alias(n.lower()) for n in names), "avg_mapq")


@query
def consensus(c: Caller) -> DataFrame:
    return _consensus(c, ~F.col("is_insertion"))


@query
def insertion_support(c: Caller) -> DataFrame:
    return c.support.groupBy(*calling.ALLELE, "pos").agg(F.count("*").alias("n_ins"), F.max("cov").alias("cov"))


@query
def insertion_filter(c: Caller) -> DataFrame:
    return calling.insertion_sites(c.support, c.params.threshold).select(*calling.ALLELE, "pos", "n_ins", "cov")


@query
def insertion_consensus(c: Caller) -> DataFrame:
    return _consensus(c, F.col("is_insertion"))


@query
def allele_hist(c: Caller) -> DataFrame:
    return stats.histogram(c.alleles_at, "n_alleles")


# ---------------------------------------------------------------- rows and statistics

@query
def tmpvarcall(c: Caller) -> DataFrame:
    return formatting.lines(c.rows).orderBy("contig_idx", "block_id", "pos", "is_insertion", "pool_allele")


@query
def variant_rows(c: Caller) -> DataFrame:
    return c.rows


def _variant_alleles(c: Caller) -> DataFrame:
    return c.rows.where("NOT is_insertion").select("n_alleles")


@query
def variant_allele_hist(c: Caller) -> DataFrame:
    return stats.histogram(_variant_alleles(c), "n_alleles")


@query
def summary_stats(c: Caller) -> DataFrame:
    named = (("block_length", c.blocks.select(F.col("length").alias("v"))), ("tags_before", c.tags.groupBy(*cluster.BLOCK).agg(F.count("*").alias("v"))), ("alleles_after", c.alleles.groupBy(*cluster.BLOCK).agg(F.count("*").alias("v"))), ("positions_tested", c.alleles_at.groupBy(*cluster.BLOCK).agg(F.count("*").alias("v"))))
    parts = [stats.summary(d, "v").select(F.lit(n).alias("vector"), "*") for n, d in named]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query
def stats_consensus(c: Caller) -> DataFrame:
    return stats.consensus_counters(c.consensus)


@query
def stats_derived(c: Caller) -> DataFrame:
    return stats.derived_counters(stats.consensus_counters(c.consensus))


@query
def pct(c: Caller) -> DataFrame:
    d = c.clusters.groupBy("region").agg(F.count("*").alias("tags"), F.count_if(F.col("tag_key") == F.col("allele_key")).alias("own"))
    return d.select("region", x.percent(F.col("own"), F.col("tags")).alias("own_pct"), x.percent(F.col("own"), F.lit(0)).alias("none_pct"))


@query
def region_blocks(c: Caller) -> DataFrame:
    return stats.region_blocks(c.contigs, c.valid_blocks.join(c.alleles, cluster.BLOCK, "left_semi"))


@query
def top_tags(c: Caller) -> DataFrame:
    return stats.top_tags(c.tags)


@query
def dropout(c: Caller) -> DataFrame:
    every = stats.dropout(c.alleles_at, "n_alleles").select(F.lit("all").alias("of"), "*")
    return every.union(stats.dropout(_variant_alleles(c), "n_alleles").select(F.lit("variants").alias("of"), "*"))


@query
def stats_run(c: Caller) -> DataFrame:
    k = stats.counters(c)
    return c.alignments.sparkSession.createDataFrame(sorted(k.items()), "counter string, n long")


@query
def crc(c: Caller) -> DataFrame:
    k = stats.counters(c)
    return c.alignments.sparkSession.createDataFrame([(f"0x{stats.fingerprint(k):08x}",)], "crc32 string")


# ---------------------------------------------------------------- the same operators on other tables

@table_query
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap islands in time: a user's events less than a day apart."""
    ev = derived.events(spark, sf_dir).select("user_id", F.unix_seconds(F.col("ts").cast("timestamp_ltz")).alias("start")).withColumn("end", F.col("start"))
    numbered = blocks.islands(ev, "user_id", "start", "end", 86_400, 1 << 40)
    return ev.join(numbered, ["user_id", "start"]).groupBy("user_id", "block_id").agg(F.count("*").alias("n"), F.min("start").alias("start"), F.max("end").alias("end"))


@table_query
def price_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.floor("o_totalprice").cast("long").alias("v"))
    return stats.summary(d, "v").select("n", "min", "q1", "q2", "q3", "max", "sum")


@table_query
def flag_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The return flag of most lines of each part; a tie gives N and is ambiguous."""
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_partkey").agg(*(F.count_if(F.col("l_returnflag") == b).alias(f"n_{b}") for b in "ARN"))
    d = d.withColumn("most", F.greatest("n_A", "n_R", "n_N"))
    letter, tie, _ = calling.majority({b: F.col(f"n_{b}") for b in "ARN"})
    return d.select("l_partkey", letter.alias("flag"), tie.alias("is_ambiguous"), F.col("most").alias("n"))
