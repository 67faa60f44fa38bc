"""Tags of a block to alleles: similarity join, connected components, coverage filter."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, pairwise
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as x
from ..tables import saved
from .blocks import depth, valid
from .components import components

BLOCK = ["region", "block_id"]
#: Tags of a block up to which all its pairs are fewer rows than its shortened tags.
FEW = 64
#: Letters taken out of tags, at most; 560 strings a tag for 3.
MOST_SHORTENED = 3
#: Edges of a block that one task joins to components; blocks of more spread their labels in rounds.
TASK_EDGES = 1 << 20
_LABELS = "region string, block_id long, tag_key string, label string"


def tag_groups(reads: DataFrame) -> DataFrame:
    """(region, block_id, tag16, tag_key, n_reads)."""
    return reads.groupBy(*BLOCK, "tag_key").agg(F.first("tag16").alias("tag16"), F.count("*").alias("n_reads"))


def _met(tags: DataFrame, on: list[str], others: DataFrame | None = None) -> DataFrame:
    """Pairs of tags (a before b) that agree on some columns; b of ``others`` where they are given."""
    a, b = (d.select(*on, F.col("tag_key").alias(f"key_{s}"), F.col("tag16").alias(f"tag_{s}")) for s, d in (("a", tags), ("b", tags if others is None else others)))
    return a.join(b, on).where(F.col("key_a") < F.col("key_b")).select(*BLOCK, "key_a", "key_b", "tag_a", "tag_b")


def tag_pairs(tags: DataFrame) -> DataFrame:
    """All pairs of a block's tags with the lower bound of their distance; for looking at, calling has no need of it."""
    return _met(tags, BLOCK).withColumn("bound", x.lower_bound(F.col("tag_a"), F.col("tag_b")))


def shortened(tag: Column, letters: int) -> Column:
    """Array of the distinct strings that a tag without so many of its letters can be."""
    out = F.array(tag)
    for left in range(x.TAG_WIDTH, x.TAG_WIDTH - letters, -1):
        without = lambda s, left=left: F.transform(F.sequence(F.lit(1), F.lit(left)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.lit(left))))
        out = F.array_distinct(F.flatten(F.transform(out, without)))
    return out


def segments(tag: Column, distance: int) -> Column:
    """Array of the (number, letters) of distance + 1 pieces of a tag; of two tags within the distance one piece at least is left whole."""
    cuts = [i * x.TAG_WIDTH // (distance + 1) for i in range(distance + 2)]
    return F.array(*(F.struct(F.lit(i).alias("i"), F.substring(tag, a + 1, b - a).alias("s")) for i, (a, b) in enumerate(pairwise(cuts))))


def shifted_segments(tag: Column, distance: int) -> Column:
    """Array of the (number, letters) that a tag has where those pieces may stand: as lengths are equal, half the distance aside at most."""
    cuts = [i * x.TAG_WIDTH // (distance + 1) for i in range(distance + 2)]
    places = [(i, a + shift, b - a) for i, (a, b) in enumerate(pairwise(cuts)) for shift in range(-(distance // 2), distance // 2 + 1) if 0 <= a + shift and b + shift <= x.TAG_WIDTH]
    return F.array_distinct(F.array(*(F.struct(F.lit(i).alias("i"), F.substring(tag, at + 1, n).alias("s")) for i, at, n in places)))


def tag_edges(tags: DataFrame, distance: int) -> DataFrame:
    """Pairs within ``distance``.

    Tags are of one length, so two within the distance agree after ``distance`` letters are taken out
    of each; above ``MOST_SHORTENED`` letters, one of distance + 1 pieces of the one stands in the
    other, hardly moved.  Blocks of many tags are joined on what is left, or on pieces; blocks of few
    on the block, which is less work there.  From the tags' length on every pair is near, and the
    block's pairs are the result.  The bound is tested before the distance.
    """
    if distance >= x.TAG_WIDTH:
        met = _met(tags, BLOCK)
    else:
        sizes = tags.groupBy(*BLOCK).agg((F.count("*") > FEW).alias("many"))
        sized = saved(tags.select(*BLOCK, "tag_key", "tag16").join(sizes, BLOCK), "sized-tags")
        many = sized.where("many")
        if distance <= MOST_SHORTENED:
            across = _met(many.withColumn("rest", F.explode(shortened(F.col("tag16"), distance))), [*BLOCK, "rest"])
        else:
            whole, moved = (many.withColumn("piece", F.explode(f(F.col("tag16"), distance))) for f in (segments, shifted_segments))
            across = _met(whole, [*BLOCK, "piece"], moved)
        met = _met(sized.where("NOT many"), BLOCK).unionByName(across.distinct())
    near = (x.lower_bound(F.col("tag_a"), F.col("tag_b")) <= distance) & (F.levenshtein("tag_a", "tag_b", distance) >= 0)
    return met.where(near).select(*BLOCK, "key_a", "key_b", "tag_a", "tag_b", F.levenshtein("tag_a", "tag_b").alias("dist"))


def pair_counts(tags: DataFrame, distance: int) -> DataFrame:
    """One row (total, complete): pairs of tags of a block, and those whose bound is within ``distance``.

    Counted without making the pairs: the bound depends on letter counts only, so classes of tags
    with the same counts are paired, and a class of n holds n (n - 1) / 2 pairs of bound 0.
    """
    counts = [f"n_{b}" for b in "NATCG"]
    classes = tags.groupBy(*BLOCK, *(x.count_letter(F.col("tag16"), b).alias(f"n_{b}") for b in "NATCG")).agg(F.count("*").alias("n"))
    a, b = (classes.select(*BLOCK, F.struct(*counts).alias(f"c_{s}"), F.col("n").alias(f"n_{s}")) for s in "ab")
    bound = sum(F.abs(F.col(f"c_a.{c}") - F.col(f"c_b.{c}")) for c in counts) / 2
    pairs = F.when(F.col("c_a") == F.col("c_b"), F.expr("n_a * (n_a - 1) div 2")).otherwise(F.col("n_a") * F.col("n_b"))
    across = a.join(b, BLOCK).where((F.col("c_a") <= F.col("c_b")) & (F.floor(bound) <= distance)).agg(F.coalesce(F.sum(pairs), F.lit(0)).alias("complete"))
    total = tags.groupBy(*BLOCK).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("total"))
    return total.crossJoin(across)  # one row each


def _components(edges: Iterator[tuple[str, str]]) -> dict[str, str]:
    """Union-find over one block's edges; the label of a key is the smallest one of its component."""
    up: dict[str, str] = {}

    def root(k: str) -> str:
        while (p := up.setdefault(k, k)) != k:
            up[k] = up[p] = up.setdefault(p, p)
            k = up[k]
        return k

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {k: root(k) for k in up}


def block_labels(edges: DataFrame) -> DataFrame:
    """(region, block_id, tag_key, label) of blocks whose edges fit a task; sorted, so a task holds one block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [*BLOCK, "tag_key", "label"])

        for (region, block), own in groupby(rows, key=itemgetter(0, 1)):
            out += [(region, block, k, label) for k, label in _components((a, b) for _, _, a, b in own).items()]
            if len(out) > 10_000:
                yield batch()
                out = []
        if out:
            yield batch()

    return edges.repartition(*BLOCK).sortWithinPartitions(*BLOCK).select(*BLOCK, "key_a", "key_b").mapInArrow(run, _LABELS)


def spread_labels(edges: DataFrame) -> DataFrame:
    """(region, block_id, tag_key, label): the smallest key of each component, without a task for a block or a tag."""
    return components(edges.withColumnsRenamed({"key_a": "a", "key_b": "b"}), BLOCK).withColumnRenamed("node", "tag_key")


def tag_components(tags: DataFrame, distance: int) -> DataFrame:
    """Tags with allele_key, the smallest tag of their component.

    With a minimum of one point and each its own neighbour, density clustering is just that.
    """
    if distance >= x.TAG_WIDTH:  # every pair is near
        least = tags.groupBy(*BLOCK).agg(F.min("tag_key").alias("allele_key"))
        return tags.join(least, BLOCK)
    edges = saved(tag_edges(tags, distance).select(*BLOCK, "key_a", "key_b"), "tag-edges")
    large = edges.groupBy(*BLOCK).agg(F.count("*").alias("n")).where(F.col("n") > TASK_EDGES).select(*BLOCK)
    large = saved(large, "large-blocks")
    if large.isEmpty():
        labels = block_labels(edges)
    else:
        labels = block_labels(edges.join(large, BLOCK, "left_anti"))
        labels = labels.unionByName(spread_labels(edges.join(large, BLOCK, "left_semi")))
    return tags.join(labels, [*BLOCK, "tag_key"], "left").withColumn("allele_key", F.coalesce("label", "tag_key")).drop("label")


def clustered(tags: DataFrame, mode: str, distance: int) -> DataFrame:
    return tags.withColumn("allele_key", F.col("tag_key")) if mode == "none" else tag_components(tags, distance)


def allele_reads(reads: DataFrame, clusters: DataFrame) -> DataFrame:
    return reads.join(clusters.select(*BLOCK, "tag_key", "allele_key"), [*BLOCK, "tag_key"])


def allele_depth(reads: DataFrame) -> DataFrame:
    return depth(reads, [*BLOCK, "allele_key"])


def alleles(reads: DataFrame, coverage: int) -> DataFrame:
    """Alleles that are covered, numbered from 1 along each block in tag order."""
    from pyspark.sql import Window

    w = Window.partitionBy(*BLOCK).orderBy("allele_key")
    return valid(allele_depth(reads), coverage).withColumn("allele_id", F.row_number().over(w))
