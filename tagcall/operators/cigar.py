"""CIGAR decoding with array functions: lengths, operation table, observed bases, insertions.

Hard clips consume no letters.  ``=`` and ``X`` raise an error, or count as M if ``extended``; other
letters always raise.  A letter outside ATCG is N; missing quality is -1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import DELETED_PHRED


def checked(cigar: Column, extended: bool = False) -> Column:
    if extended:
        cigar = F.translate(cigar, "=X", "MM")
    return F.when(F.rlike(cigar, F.lit(r"^(\d+[MIDSH])*$")), cigar).otherwise(F.raise_error(F.concat(F.lit("unknown CIGAR operation in "), cigar)))


def reference_length(cigar: Column) -> Column:
    """Reference positions that M and D cover."""
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(r"(\d+)[MD]"), 1), F.lit(0).cast("long"), lambda s, n: s + n.cast("long"))


def operations(cigar: Column) -> Column:
    """Array of (idx, op, len, ref_off, query_off)."""
    n, op = (F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDSH])"), g) for g in (1, 2))
    start = F.struct(F.lit(0).alias("r"), F.lit(0).alias("q"), F.expr("cast(array() as array<struct<idx:int,op:string,len:int,ref_off:int,query_off:int>>)").alias("out"))

    def step(s: Column, o: Column) -> Column:
        length = o["n"].cast("int")
        row = F.struct(F.size(s["out"]).alias("idx"), o["op"].alias("op"), length.alias("len"), s["r"].alias("ref_off"), s["q"].alias("query_off"))
        r = s["r"] + F.when(o["op"].isin("M", "D"), length).otherwise(0)
        q = s["q"] + F.when(o["op"].isin("M", "I", "S"), length).otherwise(0)
        return F.struct(r.alias("r"), q.alias("q"), F.concat(s["out"], F.array(row)).alias("out"))

    return F.aggregate(F.arrays_zip(n.alias("n"), op.alias("op")), start, step, lambda s: s["out"])


def with_end(reads: DataFrame, extended: bool = False) -> DataFrame:
    """Adds length and end (half open) in reference positions."""
    r = reads.withColumn("cigar", checked(F.col("cigar"), extended)).withColumn("length", reference_length(F.col("cigar")))
    return r.withColumn("end", F.col("start") + F.col("length"))


def _base(at: Column) -> Column:
    b = F.substring("seq", at + 1, F.lit(1))
    return F.when(b.isin("A", "T", "C", "G"), b).otherwise("N")


def _phred(at: Column) -> Column:
    return F.when(F.col("qual") == "*", -1).otherwise(F.ascii(F.substring("qual", at + 1, F.lit(1))) - 33)


def observed(reads: DataFrame, phred: int, keep: list[str]) -> DataFrame:
    """One row for each covered position of each read: ``keep`` columns, pos, base, phred."""
    ops = F.filter(operations(F.col("cigar")), lambda o: o["op"].isin("M", "D") & (o["len"] > 0))
    d = reads.select(*keep, "start", "seq", "qual", F.explode(ops).alias("o"))
    d = d.select("*", F.explode(F.sequence(F.lit(0), F.col("o.len") - 1)).alias("i"))
    at = F.col("o.query_off") + F.col("i")
    deleted = F.col("o.op") == "D"
    q = F.when(deleted, DELETED_PHRED).otherwise(_phred(at))
    d = d.select(*keep, (F.col("start") + F.col("o.ref_off") + F.col("i")).alias("pos"), F.when(deleted, "D").otherwise(_base(at)).alias("base"), q.alias("phred"))
    return d.withColumn("base", F.when((F.col("base") != "D") & (F.col("phred") < phred), "N").otherwise(F.col("base")))


def insertions(reads: DataFrame, phred: int, keep: list[str]) -> DataFrame:
    """One row for each insertion: ``keep``, pos (the next reference position), bases, phreds.

    Of several at one position of a read the last counts.
    """
    own = F.filter(operations(F.col("cigar")), lambda o: (o["op"] == "I") & (o["len"] > 0))
    d = reads.where(F.col("cigar").contains("I")).select(*keep, "start", "seq", "qual", F.explode(F.array(own)).alias("ops"))
    last = F.filter("ops", lambda o: ~F.exists("ops", lambda p: (p["ref_off"] == o["ref_off"]) & (p["idx"] > o["idx"])))
    d = d.select(*keep, "start", "seq", "qual", F.explode(last).alias("o"))
    places = F.sequence(F.lit(0), F.col("o.len") - 1)
    phreds = F.transform(places, lambda i: _phred(F.col("o.query_off") + i))
    bases = F.transform(places, lambda i: F.when(_phred(F.col("o.query_off") + i) < phred, "N").otherwise(_base(F.col("o.query_off") + i)))
    return d.select(*keep, (F.col("start") + F.col("o.ref_off")).alias("pos"), bases.alias("bases"), phreds.alias("phreds"))
