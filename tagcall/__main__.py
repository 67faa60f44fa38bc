"""Command line: ``python -m tagcall -i reads.bam -f ref.fa -T`` prints variant rows, ``-s`` the report."""

from __future__ import annotations

import argparse
import sys

from .params import ORIENTATIONS, TAG_SLOTS, Params


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("tagcall", description="Variant calling over molecule-tagged reads")
    p.add_argument("-i", "--input", required=True, help="alignments: .bam, .sam, or a Parquet table")
    p.add_argument("-f", "--reference", required=True, help="reference: FASTA, or a Parquet table of region, pos, ref_base or of pieces")
    p.add_argument("-m", "--mapq", type=int, default=0, help="least mapping quality")
    p.add_argument("-p", "--phredscore", type=int, default=0, help="bases below become N")
    p.add_argument("-b", "--threshold", type=float, default=0.7, help="acceptance threshold")
    p.add_argument("-c", "--coverage", type=int, default=5, help="least reads and depth")
    p.add_argument("-d", "--distance", type=int, default=2, help="largest edit distance of tags of one allele")
    p.add_argument("-C", "--clustermode", choices=("none", "dbscan"), default="none")
    p.add_argument("-r", "--region", action="append", help="contig; repeat for more; all by default")
    p.add_argument("-u", "--tag", action="append", choices=TAG_SLOTS)
    p.add_argument("-O", "--orientation", action="append", choices=(*ORIENTATIONS, "all"))
    p.add_argument("-F", "--forward", action="store_true", help="forward reads only")
    p.add_argument("-R", "--reverse", action="store_true", help="reverse reads only")
    p.add_argument("-s", "--stats", action="store_true", help="print the statistics report")
    p.add_argument("-T", "--tmpvc", action="store_true", help="print variant rows")
    p.add_argument("-o", "--output", help="write variant rows as text files to this folder")
    p.add_argument("-t", "--threads", default="*", help="local threads, where no cluster is set")
    p.add_argument("-v", "--verbose", action="count", default=0, help="-v blocks, -vv rows, -vvv clusters, -vvvv alleles")
    p.add_argument("-V", "--version", action="version", version="tagcall 1")
    return p


def params(a: argparse.Namespace) -> Params:
    turned = ORIENTATIONS if not a.orientation or "all" in a.orientation else tuple(a.orientation)
    return Params(
        mapq=a.mapq, phred=a.phredscore, threshold=a.threshold, coverage=a.coverage, distance=a.distance, cluster=a.clustermode, regions=tuple(a.region or ("all",)),
        tags=tuple(a.tag or ("F1",)), orientations=turned, forward=not a.reverse, reverse=not a.forward,
    )


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    p = params(a)
    from pyspark.sql import SparkSession

    from .operators import display, formatting
    from .operators.report import report
    from .plans.caller import Caller
    from .sources import bam, fasta, sam

    builder = SparkSession.builder.appName("tagcall")
    spark = builder.getOrCreate() if SparkSession.getActiveSession() else builder.config("spark.master", f"local[{a.threads}]").getOrCreate()
    header: list[str] | None = None
    if a.input.endswith(".bam"):
        reads, header = bam.load(spark, a.input), bam.header_contigs(a.input)
    elif a.input.endswith(".sam"):
        reads, header = sam.read_sam(spark, a.input), sam.header_contigs(spark, a.input)
    else:
        reads = spark.read.parquet(a.input)
    if header and not p.all_regions and (unknown := sorted(set(p.regions) - set(header))):
        print(f"no such contig: {', '.join(unknown)}", file=sys.stderr)
        return 2
    text = a.reference.endswith((".fa", ".fasta", ".fna"))
    run = Caller(reads, fasta.read_reference(spark, a.reference) if text else spark.read.parquet(a.reference), p, header)
    print(*p.lines(), sep="\n", file=sys.stderr)
    if a.output:
        formatting.write_text(run.rows, a.output)
    if a.tmpvc or a.verbose >= 2:
        for row in formatting.lines(run.rows).orderBy("contig_idx", "block_id", "pos", "is_insertion", "pool_allele").toLocalIterator():
            print(row["line"])
    views = [f for level, f in ((1, display.blocks_text), (3, display.clusters_text), (4, display.alleles_text)) if a.verbose >= level]
    for view in views:
        d = view(run)
        order = ["contig_idx", *(c for c in ("block_id", "allele_id") if c in d.columns)]
        for row in d.join(run.contigs.select("region", "contig_idx"), "region").orderBy(*order).toLocalIterator():
            print(row["text"])
    if a.stats:
        print(report(run))
    return 0


if __name__ == "__main__":
    sys.exit(main())
