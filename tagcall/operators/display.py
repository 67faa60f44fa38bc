"""Text views of a run's blocks, clusters and alleles; of each the first ``MOST`` members, by a rank within it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import cigar, reference
from .calling import ALLELE
from .cluster import BLOCK

#: Members of a block, a cluster or an allele that are shown.
MOST = 200


def first_members(rows: DataFrame, of: list[str], order: list[Column], most: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*of).orderBy(*order))).where(F.col("place") <= most)


def blocks_text(run, most: int = MOST) -> DataFrame:
    """(region, block_id, text): each block's span and depth, and its reads by start."""
    reads = first_members(run.reads_in_blocks, BLOCK, [F.col("start"), F.col("qname"), F.col("flag")], most)
    line = F.format_string("  %d %d %s %s", "start", "end", "qname", "cigar")
    shown = reads.groupBy(*BLOCK).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda v: v["line"]), "\n").alias("members"))
    head = F.format_string("block %d in %s: %d to %d, %d positions, %d reads, depth %d", "block_id", "region", "start", "end", "length", "n_reads", "max_depth")
    return run.blocks.join(shown, BLOCK).select(*BLOCK, F.concat_ws("\n", head, "members").alias("text"))


def clusters_text(run, most: int = MOST) -> DataFrame:
    """(region, block_id, text): for each cluster of a block its tag, its reads and the tags that it took, those of most reads first."""
    d = first_members(run.clusters, [*BLOCK, "allele_key"], [F.desc("n_reads"), F.col("tag_key")], most)
    member = F.struct("place", F.format_string("%s*%d", "tag16", "n_reads").alias("t"))
    own = d.groupBy(*BLOCK, "allele_key").agg(F.max(F.when(F.col("tag_key") == F.col("allele_key"), F.col("tag16"))).alias("tag"), F.array_sort(F.collect_list(member)).alias("m"))
    sizes = run.clusters.groupBy(*BLOCK, "allele_key").agg(F.sum("n_reads").alias("reads"), F.count("*").alias("tags"), F.max(F.when(F.col("tag_key") == F.col("allele_key"), F.col("tag16"))).alias("own_tag"))
    own = own.drop("tag").join(sizes, [*BLOCK, "allele_key"])
    line = F.format_string("  %s, %d reads of %d tags <- %s", "own_tag", "reads", "tags", F.array_join(F.transform("m", lambda v: v["t"]), " "))
    lines = first_members(own.withColumn("line", line), BLOCK, [F.desc("reads"), F.col("allele_key")], most)
    shown = lines.groupBy(*BLOCK).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda v: v["line"]), "\n").alias("members"))
    return shown.select(*BLOCK, F.concat_ws("\n", F.format_string("clusters of block %d in %s", "block_id", "region"), "members").alias("text"))


def aligned(start: int, letters: str, reads: list[dict]) -> list[str]:
    """The rows of a view: the reference, then each read below it.

    ``.`` is a letter of the reference, ``-`` a deleted one; before a position stands a column for each
    letter of the longest insertion there, where ``*`` fills what the reference and other reads lack.
    """
    taken = []
    for r in reads:
        at, inserted, covered = r["start"], {}, {}
        for o in r["ops"]:
            bases = r["seq"][o["query_off"] : o["query_off"] + o["len"]]
            place = at + o["ref_off"]
            if o["op"] == "I":
                inserted[place] = bases.lower()
            elif o["op"] == "D":
                covered |= dict.fromkeys(range(place, place + o["len"]), "-")
            elif o["op"] == "M":
                covered |= {place + i: b for i, b in enumerate(bases)}
        taken.append((covered, inserted))
    width: dict[int, int] = {}
    for _, inserted in taken:
        for p, b in inserted.items():
            width[p] = max(width.get(p, 0), len(b))
    places = range(start, start + len(letters))
    out = ["".join("*" * width.get(p, 0) + b for p, b in zip(places, letters, strict=True))]
    for covered, inserted in taken:
        low, high = min(covered, default=0), max(covered, default=-1)
        row = []
        for p, ref in zip(places, letters, strict=True):
            inside = low < p <= high
            row.append((inserted.get(p, "") if inside else "").ljust(width.get(p, 0), "*" if inside else " "))
            b = covered.get(p, " ")
            row.append("." if b == ref else b)
        out.append("".join(row).rstrip())
    return out


def alleles_text(run, most: int = MOST) -> DataFrame:
    """(region, block_id, allele_id, text): each allele's reads by start, below the reference and in its columns."""
    order = [F.col("start"), F.col("qname"), F.col("flag")]
    ops = cigar.operations(F.col("cigar"))
    reads = first_members(run.allele_reads, ALLELE, order, most).select(*ALLELE, F.struct("place", "start", "seq", "orientation", "is_forward", "tag16", ops.alias("ops")).alias("r"))
    shown = reads.groupBy(*ALLELE).agg(F.array_sort(F.transform(F.collect_list("r"), lambda r: F.struct(r["place"].alias("place"), r.alias("r")))).alias("reads"))
    spans = run.alleles.select(*ALLELE, F.col("start").alias("from"), F.col("end").alias("to"), "n_reads", "max_depth")
    # one slice an allele, named by its place in the block
    pieces = reference.pieces(run.reference)
    named = spans.select("region", F.struct("block_id", "allele_id").alias("block_id"), F.col("from").alias("start"), F.col("to").alias("end"))
    letters = reference.slices(pieces, named, gaps=True).select("region", "block_id.block_id", "block_id.allele_id", "ref_seq")

    def run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for r in batch.to_pylist():
                rows = [x["r"] for x in r["reads"]]
                view = aligned(r["from"], r["ref_seq"], rows)
                head = f"allele {r['allele_id']} of block {r['block_id']} in {r['region']}: {r['from']} to {r['to']}, {r['n_reads']} reads, depth {r['max_depth']}"
                side = [f"{r['from']:>10} reference".ljust(33)] + [f"{x['start']:>10} {x['orientation']} {'F' if x['is_forward'] else 'R'} {x['tag16']:16} " for x in rows]
                texts.append("\n".join([head, *(a + b for a, b in zip(side, view, strict=True))]))
            yield pa.RecordBatch.from_arrays([batch.column("region"), batch.column("block_id"), batch.column("allele_id"), pa.array(texts, pa.string())], [*ALLELE, "text"])

    d = shown.join(spans, ALLELE).join(letters, ALLELE).select(*ALLELE, "from", "to", "n_reads", "max_depth", "ref_seq", "reads")
    return d.mapInArrow(run_rows, "region string, block_id long, allele_id int, text string")


def display_allele(run, region: str, block_id: int, allele_id: int, most: int = MOST) -> str | None:
    """The view of one allele; None if there is none."""
    row = alleles_text(run, most).where((F.col("region") == region) & (F.col("block_id") == block_id) & (F.col("allele_id") == allele_id)).first()
    return row and row["text"]
