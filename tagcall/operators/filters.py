"""From alignments to tagged reads: filters, orientation classes and tag choice; all narrow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as x
from ..params import TAG_SLOTS, Params


def _once(d: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Columns of one generated row, so that later filters and columns read them and do not repeat what makes them."""
    made = F.struct(*(c.alias(name) for name, c in columns.items()))
    return d.select(*(c for c in d.columns if c not in columns), F.inline(F.array(made)))


def with_tags(aln: DataFrame) -> DataFrame:
    """Adds f1, f2, r1, r2 as written in the name."""
    d = _once(aln, {"pieces": F.split("qname", "_")})
    return d.withColumns({s.lower(): x.slot_of(F.col("pieces"), i) for i, s in enumerate(TAG_SLOTS)}).drop("pieces")


def with_orientation(aln: DataFrame) -> DataFrame:
    return _once(aln, {"orientation": x.orientation(F.col("flag")), "is_forward": x.is_forward(F.col("flag"))})


def swap_tags(reads: DataFrame) -> DataFrame:
    """RF reads hold their tags the other way round."""
    rf = F.coalesce(F.col("orientation") == "RF", F.lit(False))
    return _once(reads, {a: F.when(rf, F.col(b)).otherwise(F.col(a)) for a, b in (("f1", "r1"), ("r1", "f1"), ("f2", "r2"), ("r2", "f2"))})


def with_mask(reads: DataFrame) -> DataFrame:
    return reads.withColumn("tag_mask", x.tag_mask(*(F.col(s.lower()) for s in TAG_SLOTS)))


def passes(p: Params):
    """Condition on flag, mapq and region; reaches the scan as pushed filters where the source allows."""
    flag = F.col("flag")
    ok = x.is_usable(flag) & x.is_proper_pair(flag)
    if p.mapq:
        ok = (F.col("mapq") >= p.mapq) & ok
    if not p.all_regions:
        ok = F.col("region").isin(*p.regions) & ok
    if not p.reverse:
        ok = ok & x.is_forward(flag)
    if not p.forward:
        ok = ok & ~x.is_forward(flag)
    return ok


def tagged_reads(aln: DataFrame, p: Params) -> DataFrame:
    """Reads that pass every filter, with tag, tag16, tag_key, orientation, is_forward."""
    r = with_mask(swap_tags(with_orientation(with_tags(aln.where(passes(p))))))
    wanted = tuple(TAG_SLOTS.index(t) for t in p.tags)
    chosen = x.tag_select(tuple(F.col(s.lower()) for s in TAG_SLOTS), wanted)
    r = r.where(F.col("orientation").isin(*p.orientations) & F.col("tag_mask").isin(*x.TAG_MASKS)).withColumn("tag", chosen).where("tag IS NOT NULL")
    return r.select(
        "qname", "flag", "region", F.col("pos").cast("long").alias("start"), "mapq", "cigar", "seq", "qual",
        "tag", x.tag16(F.col("tag")).alias("tag16"), x.tag_key(F.col("tag")).alias("tag_key"), "orientation", "is_forward",
    )
