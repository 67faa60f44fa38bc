"""The statistics report of a run as text: five sections in a fixed order, then the fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stats
from .cluster import BLOCK


def banner(title: str) -> str:
    return f"==== {title} ".ljust(60, "=")


def _share(part: int, whole: int) -> str:
    return f"{100.0 * part / whole:.2f}" if whole else "-"


def _summary(name: str, values: DataFrame) -> str:
    s = stats.summary(values, "v").first().asDict()
    return f"{name}\t" + "\t".join(f"{k}={v}" for k, v in s.items())


def report(run) -> str:
    """All sections; every figure comes from an aggregation, so little reaches the driver."""
    k = stats.counters(run)
    per_block = lambda d: d.groupBy(*BLOCK).agg(F.count("*").alias("v"))
    out = [banner("Summary"), f"regions with blocks\t{run.valid_blocks.select('region').distinct().count()}", f"reads in regions\t{k['reads_in_file']}", f"reads in valid blocks\t{k['reads_in_valid_blocks']}", f"blocks before, after\t{k['blocks']}\t{k['blocks_after']}"]
    out += [_summary("block length before", run.blocks.select(F.col("length").alias("v"))), _summary("positions tested after", per_block(run.alleles_at))]
    survivors = run.valid_blocks.join(run.alleles, BLOCK, "left_semi")
    out += [f"blocks in {r['region']}\t{r['blocks']}\t{r['pct']} %" for r in stats.region_blocks(run.contigs, survivors).orderBy("contig_idx").toLocalIterator()]
    out += [banner("Clustering"), f"distances total, full, cut\t{k['leven_total']}\t{k['leven_complete']}\t{k['leven_total'] - k['leven_complete']}", f"alleles before, after\t{k['tags_before']}\t{k['alleles_after']}"]
    out += [_summary("alleles before", per_block(run.tags)), _summary("alleles after", per_block(run.alleles)), f"reads before, after\t{k['reads_before']}\t{k['reads_after']}", f"tags\t{run.tags.select('tag_key').distinct().count()}"]
    out += [f"tag {r['tag16']}\t{r['n']}" for r in stats.top_tags(run.tags).collect()]
    out += [banner("Reference"), f"bases loaded\t{k['reference_bases']}", f"positions tested\t{k['positions_tested']}"]

    def alleles(d: DataFrame) -> list[str]:
        r = stats.dropout(d, "n_alleles").first()
        lines = [f"one, two, more alleles\t{r['one_allele']}\t{r['two_alleles']}\t{r['more_alleles']}", f"dropout\t{r['one_allele']}\t{r['dropout_pct']} %"]
        bars = {b["bucket"]: b["n"] for b in stats.histogram(d, "n_alleles").collect()}
        return lines + [f"alleles {i}\t{bars.get(i, 0)}" for i in range(1, stats.BUCKETS + 1)] + [f"alleles {stats.BUCKETS + 1} and more\t{bars.get(0, 0)}"]

    out += [banner("Global alleles"), *alleles(run.alleles_at), banner("Variants"), f"positions with variants\t{k['positions_with_variants']}"]
    d = stats.derived_counters(stats.consensus_counters(run.consensus)).first().asDict()
    d["ambiguous_del"] = d["total_del"] - d["conclusive_del"] - d["inconclusive_del"]
    for kind in ("", "_ins", "_del", "_snp"):
        out.append(f"{kind[1:] or 'all'}\t" + "\t".join(f"{x}={d[x + kind]} ({_share(d[x + kind], d['total' + kind])} %)" for x in ("total", "conclusive", "inconclusive", "ambiguous")))
    out += alleles(run.rows.where("NOT is_insertion").select("n_alleles"))
    return "\n".join([*out, f"CRC32  0x{stats.fingerprint(k):08x}"])
