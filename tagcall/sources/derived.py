"""Alignments and a reference derived from the ``events`` table by integer arithmetic.

One read of 30 bases for each event on five contigs; the formulas are in FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reference import PIECE, piece_of

CONTIGS = 5
LENGTH = 30
#: Positions after which the reference's letters repeat, and those of a molecule, which differ where a multiple of 23 falls.
PERIOD, MOLECULE_PERIOD = 44, 44 * 23
#: Molecules are the remainders by 4, from -3 where ids are negative.
_MOLS = range(-3, 4)
_STRIDE = MOLECULE_PERIOD + 2 * LENGTH


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a.cast("long"), F.lit(b).cast("long"))


def reference_code(p: int) -> int:
    return (p * p * 7 + p * 3 + 5) // 11


def _letter(code: Column) -> Column:
    return F.substring(F.lit("ATCG"), (code % 4 + 1).cast("int"), F.lit(1))


def _table(text: str) -> Column:
    """Bytes, as a place in bytes is found without a walk."""
    return F.lit(bytearray(text, "ascii"))


#: Letters of a molecule over its period, one molecule after another.
_MOLECULES = "".join("ATCG"[(reference_code(p) + ((p * 31 + mol * 7) % 23 == 0)) % 4] for mol in _MOLS for p in range(_STRIDE))
#: Quality letters by e + q from -70 on, with remainders of the sign of their dividend.
_QUALITIES = "".join(chr(33 + 20 + (t % 21 if t >= 0 else -(-t % 21))) for t in range(-70, 21 + LENGTH))


def alignments(ev: DataFrame) -> DataFrame:
    """(qname, region, pos, mapq, flag, cigar, seq, qual), one row for each event.

    Letters repeat with the position, so a read's are cut from the period, and the one that its id changes is put in.
    """
    e = F.col("e")
    d = ev.select(F.col("event_id").alias("e")).withColumns({"locus": _div(e, 40), "j": e % 40})
    d = d.withColumns({"mol": (F.col("j") * 7 + F.col("locus")) % 4, "off": (F.col("j") * 13) % 17, "row": _div(F.col("locus"), 5)})
    d = d.withColumns({"k": 20 - F.col("off"), "pos": F.col("row") * 80 + F.when(F.col("row") % 7 == 3, 30).otherwise(0) + F.col("off"), "form": F.when(e % 10 == 1, 1).when(F.col("mol") == 2, 2).when(F.col("mol") == 3, 3).otherwise(0), "code": ((F.col("locus") * 4 + F.col("mol")) * 40503 + 977) % 65536})
    d = d.withColumn("tag0", F.concat(*(_letter(F.shiftright("code", 2 * q)) for q in range(8))))
    tag = F.when(e % 13 == 0, F.concat(F.lit("A"), F.substring("tag0", 2, 7))).when(e % 17 == 0, F.substring("tag0", 1, 7)).when(e % 29 == 3, "NA").otherwise(F.col("tag0"))
    qname = F.concat(F.lit("q"), e.cast("string"), F.lit("_F1_"), tag, F.lit("_F2_NA_R1_GC"), F.substring("tag0", 1, 6), F.lit("_R2_NA"))
    flag = F.when(e % 11 == 5, 83).when(e % 19 == 7, 67).when(e % 2 == 0, 99).otherwise(147) + F.when(e % 23 == 4, 1024).otherwise(0)
    k = F.col("k")
    cigar = F.when(F.col("form") == 0, "30M").when(F.col("form") == 1, "3S27M").when(F.col("form") == 2, F.concat(k, F.lit("M2D"), 30 - k, F.lit("M"))).otherwise(F.concat(k, F.lit("M2I"), 28 - k, F.lit("M")))

    def cut(p: Column, n: Column | int) -> Column:
        at = (F.col("mol") - _MOLS[0]) * _STRIDE + F.pmod(p, F.lit(MOLECULE_PERIOD)) + 1
        return F.substring(_table(_MOLECULES), at.cast("int"), (F.lit(n) if isinstance(n, int) else n).cast("int")).cast("string")

    pos, form = F.col("pos"), F.col("form")
    whole = F.when(form == 0, cut(pos, LENGTH)).when(form == 1, cut(pos - 3, LENGTH)).when(form == 2, F.concat(cut(pos, k), cut(pos + k + 2, LENGTH - k))).otherwise(F.concat(cut(pos, k), F.lit("GT"), cut(pos + k, LENGTH - 2 - k)))
    d = d.withColumn("whole", F.substring(whole, 1, LENGTH))
    q = F.pmod(F.pmod(e, F.lit(47)) * (-37 * pow(11, -1, 47) % 47), F.lit(47)).cast("int")  # (37 e + 11 q) % 47 = 0
    changed = F.concat(F.substring("whole", F.lit(1), q), F.translate(F.substring("whole", q + 1, F.lit(1)), "ATCG", "CGAT"), F.substring("whole", q + 2, F.lit(LENGTH)))
    seq = F.when((q >= LENGTH) | ((form == 3) & ((q == k) | (q == k + 1))), F.col("whole")).otherwise(changed)
    first = F.when(e >= 0, e % 21).when(e > -LENGTH, e).otherwise(e % 21 - 42)
    qual = F.substring(_table(_QUALITIES), (first + 71).cast("int"), F.lit(LENGTH)).cast("string")

    # one generated row, so that no later filter repeats these long expressions
    return d.select(F.inline(F.array(F.struct(
        qname.alias("qname"),
        F.concat(F.lit("chr"), F.col("locus") % CONTIGS + 1).alias("region"),
        F.col("pos").cast("long").alias("pos"),
        (20 + e % 41).alias("mapq"),
        flag.cast("long").alias("flag"),
        cigar.alias("cigar"),
        F.coalesce(seq, F.lit("")).alias("seq"),
        F.coalesce(qual, F.lit("")).alias("qual"),
    ))))


def reference(ev: DataFrame) -> DataFrame:
    """(region, piece, letters) of the five contigs, as far as any read reaches."""
    last = ev.agg((_div(_div(F.max("event_id"), 40), 5) * 80 + 30 + 17 + LENGTH + 2).alias("last")).where("last IS NOT NULL")
    d = last.select("last", F.explode(F.sequence(F.lit(0).cast("long"), piece_of(F.col("last")))).alias("piece"))
    begin = F.col("piece") * PIECE
    period = "".join("ATCG"[reference_code(p) % 4] for p in range(PERIOD))
    letters = F.substring(_table(period * (PIECE // PERIOD + 2)), (begin % PERIOD + 1).cast("int"), (F.least("last", begin + PIECE - 1) - begin + 1).cast("int"))
    return d.select("piece", letters.alias("letters")).select(F.explode(F.array(*(F.lit(f"chr{i + 1}") for i in range(CONTIGS)))).alias("region"), "piece", "letters")
