"""What keeps the calling run's work in proportion to its reads."""

import random

import numpy as np
from pyspark.sql import functions as F

from tagcall import queries
from tagcall.operators import calling, filters, reference, votes
from tagcall.sources import derived


def test_positions_meet_short_stretches(spark):
    """A position is joined to few letters, not to a piece of 65,536; over both ends of pieces, gaps and places before the first."""
    r = random.Random(4)
    text = "".join(r.choice("ATCG") for _ in range(reference.PIECE + 700))
    ref = spark.createDataFrame([("c", 0, bytearray(text[: reference.PIECE], "ascii")), ("c", 1, bytearray(text[reference.PIECE :], "ascii"))], "region string, piece long, letters binary")
    assert reference.stretches(ref).agg(F.max(F.length("letters"))).first()[0] <= reference.STRETCH
    at = [-300, -3, -1, 0, 255, 256, reference.PIECE - 1, reference.PIECE, len(text) - 1, len(text)]
    v = spark.createDataFrame([("c", p, 1, *([0] * 6)) for p in at], "region string, pos long, cov long, " + ", ".join(f"{n} long" for n in votes.COUNTS))
    got = {x["pos"]: x["ref_base"] for x in calling.with_reference(v, ref).collect()}
    assert got == {p: text[p] for p in at if 0 <= p < len(text)}


def test_votes_of_thin_and_dense_groups():
    """Distinct (group, position) of entries, whether spans are laid out or sorted."""
    r = np.random.default_rng(1)
    for width in (5, 1 << 40):
        group, pos = r.integers(0, 4, 500) * 2, r.integers(-width, width, 500)
        owner, place, inverse = votes._cells(group, pos)
        assert (owner[inverse] == group).all() and (place[inverse] == pos).all()
        assert list(zip(owner, place, strict=True)) == sorted(set(zip(group, pos, strict=True)))


def test_reads_lie_in_order(spark, data):
    """Reads of a block lie together, so votes of a batch add up where they lie: no more rows go on than positions, but for the parts' ends."""
    run = queries.caller(spark, data)
    at = F.regexp_extract("qname", r"q(\d+)_", 1).cast("long")
    d = run.alignments.select(F.input_file_name().alias("f"), at.alias("e")).groupBy("f").agg(F.min("e").alias("a"), F.max("e").alias("b"), F.count("*").alias("n")).collect()
    assert all(r["b"] - r["a"] + 1 == r["n"] for r in d)


def test_shared_tables_are_written_once(spark, data):
    run = queries.caller(spark, data)
    assert run.blocks._written_at and run.tags._written_at


def test_letters_are_cut_from_tables(spark):
    """Against the formulas, also for ids below zero; no function is called for each letter of a read."""
    ids = [*range(-700, 700), 10**9 + 7]
    d = derived.alignments(spark.createDataFrame([(e,) for e in ids], "event_id long"))
    assert "lambdafunction" not in d._jdf.queryExecution().optimizedPlan().toString()
    rem = lambda a, b: a % b if a >= 0 else -(-a % b)  # noqa: E731  with the sign of the dividend
    div = lambda a, b: a // b if a >= 0 else -(-a // b)
    got = {r["qname"].split("_")[0][1:]: (r["seq"], r["qual"]) for r in d.collect()}
    for e in ids:
        locus, j = div(e, 40), rem(e, 40)
        mol, off, row = rem(j * 7 + locus, 4), rem(j * 13, 17), div(locus, 5)
        k, pos = 20 - off, row * 80 + (30 if rem(row, 7) == 3 else 0) + off
        form = 1 if rem(e, 10) == 1 else mol if mol in (2, 3) else 0
        seq = ""
        for q in range(30):
            p = pos + q - (3 if form == 1 else -2 if form == 2 and q >= k else 2 if form == 3 and q >= k else 0)
            code = (p * p * 7 + p * 3 + 5) // 11 + ((p * 31 + mol * 7) % 23 == 0) + 2 * ((e * 37 + q * 11) % 47 == 0)
            seq += "G" if form == 3 and q == k else "T" if form == 3 and q == k + 1 else "ATCG"[code % 4]
        assert got[str(e)] == (seq, "".join(chr(53 + rem(e + q, 21)) for q in range(30))), e


def test_names_are_split_once(spark, data):
    d = filters.tagged_reads(queries.caller(spark, data).alignments, queries.caller(spark, data).params)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(qname") == 1
