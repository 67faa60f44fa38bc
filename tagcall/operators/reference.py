"""The reference in pieces: (region, piece, letters), ``PIECE`` positions a row, so a genome is some ten thousand rows.

Letters are upper-case bytes, as a place in bytes is found without a walk; a blank stands for a position without a letter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 16
#: Positions of a stretch that single positions are joined to: a row joined to a piece would copy all of it.
STRETCH = 1 << 8
#: Letters of a reference that are broadcast, at most.
BROADCAST_LETTERS = 1 << 25


def piece_of(pos: Column) -> Column:
    return F.call_function("div", pos.cast("long"), F.lit(PIECE).cast("long"))


def stretch_of(pos: Column) -> Column:
    return F.floor(pos / STRETCH)


def letter_at(pos: Column) -> Column:
    """The letter of a position in the stretch joined to it; null where there is none."""
    letter = F.substring("letters", (F.pmod(pos, F.lit(STRETCH)) + 1).cast("int"), F.lit(1)).cast("string")
    return F.when((letter != " ") & (letter != ""), letter)


def stretches(reference: DataFrame) -> DataFrame:
    """(region, stretch, letters), to be joined to positions: broadcast where the letters counted are few, else shuffled."""
    each = pieces(reference)
    total = each.agg(F.sum(F.length("letters"))).first()[0] or 0
    within = F.explode(F.sequence(F.lit(0), F.call_function("div", F.length("letters") - 1, F.lit(STRETCH)).cast("int")))
    d = each.where(F.length("letters") > 0).select("region", "piece", "letters", within.alias("i"))
    d = d.select("region", (F.col("piece") * (PIECE // STRETCH) + F.col("i")).alias("stretch"), F.substring("letters", F.col("i") * STRETCH + 1, F.lit(STRETCH)).alias("letters"))
    return F.broadcast(d) if total <= BROADCAST_LETTERS else d.hint("shuffle_hash")


def pieces(reference: DataFrame) -> DataFrame:
    """A reference of either form, pieces or rows (region, pos, ref_base), as pieces."""
    if "letters" in reference.columns:
        return reference
    d = reference.groupBy("region", piece_of(F.col("pos")).alias("piece")).agg(F.array_sort(F.collect_list(F.struct((F.col("pos") % PIECE).cast("int").alias("at"), F.upper("ref_base").alias("base")))).alias("s"))
    gap = lambda x, i: x["at"] - F.when(i == 0, -1).otherwise(F.get("s", i - 1)["at"]) - 1
    filled = F.transform("s", lambda x, i: F.concat(F.repeat(F.lit(" "), gap(x, i)), x["base"]))
    return d.select("region", "piece", F.array_join(filled, "").cast("binary").alias("letters"))


def slices(reference: DataFrame, blocks: DataFrame, gaps: bool = False) -> DataFrame:
    """(region, block_id, start, end, ref_seq): letters of each block's span; a block asks for its few pieces by an equi-join.

    Positions without a letter are left out, or blanks if ``gaps``.
    """
    spans = blocks.where(F.col("end") > F.col("start")).select("region", "block_id", "start", "end", F.explode(F.sequence(piece_of(F.col("start")), piece_of(F.col("end") - 1))).alias("piece"))
    first = F.greatest(F.col("start") - F.col("piece") * PIECE, F.lit(0))
    n = F.least(F.col("end") - F.col("piece") * PIECE, F.lit(PIECE)) - first
    part = F.substring("letters", (first + 1).cast("int"), n.cast("int")).cast("string")
    got = spans.join(pieces(reference), ["region", "piece"]).select("region", "block_id", "start", "end", F.struct("piece", part.alias("part")).alias("p"))
    got = got.groupBy("region", "block_id", "start", "end").agg(F.array_sort(F.collect_list("p")).alias("s"))
    text = F.array_join(F.transform("s", lambda v: v["part"]), "")
    text = F.rpad(text, (F.col("end") - F.col("start")).cast("int"), F.lit(" ")) if gaps else F.replace(text, F.lit(" "), F.lit(""))
    return got.select("region", "block_id", "start", "end", text.alias("ref_seq"))
