"""Hand-written cases, one for each rule that the derived reads do not reach."""

import random

import pytest
from pyspark.sql import functions as F

from tagcall.functions import exprs as x
from tagcall.operators import blocks, calling, cigar, cluster, contigs, filters, formatting, stats
from tagcall.params import Params
from tagcall.plans.caller import Caller

ALN = "qname string, region string, pos long, mapq long, flag long, cigar string, seq string, qual string"


def reads(spark, spans, region="c"):
    return spark.createDataFrame([(f"r{i}", 0, region, a, b) for i, (a, b) in enumerate(spans)], "qname string, flag int, region string, start long, end long")


def number(spark, spans, **more):
    out = blocks.islands(reads(spark, spans), **more).collect()
    return {r["start"]: r["block_id"] for r in out}


@pytest.mark.parametrize("width", [1 << 20, 16])
def test_islands(spark, width):
    assert number(spark, [(0, 30), (40, 60)], bin_width=width) == {0: 1, 40: 2}
    assert number(spark, [(0, 30), (39, 60)], bin_width=width) == {0: 1, 39: 1}
    assert number(spark, [(0, 100), (5, 20), (105, 120), (130, 140)], bin_width=width) == {0: 1, 5: 1, 105: 1, 130: 2}


def test_islands_like_a_loop(spark):
    import random

    r = random.Random(3)
    spans = [(s := r.randrange(3000), s + r.randrange(1, 40)) for _ in range(150)]
    want, top, n = {}, None, 0
    for a, b in sorted(spans):
        if top is None or a >= top + 10:
            n += 1
        top = b if top is None else max(top, b)
        want[a] = n
    assert number(spark, spans, bin_width=64) == want


def test_depth_filter(spark):
    d = reads(spark, [(0, 10), (1, 11), (2, 12), (3, 13), (12, 20)]).withColumn("block_id", F.lit(1))
    got = blocks.depth(d, ["region", "block_id"]).first()
    assert (got["n_reads"], got["max_depth"], got["length"]) == (5, 4, 20)
    assert blocks.valid(blocks.depth(d, ["region", "block_id"]), 5).count() == 0


def masks(spark, tags):
    rows = [("q_F1_{}_F2_{}_R1_{}_R2_{}".format(*("AAA" if m >> i & 1 else "NA" for i in range(4))), "c", 0, 60, 99, "3M", "ACG", "III") for m in range(16)]
    out = filters.tagged_reads(spark.createDataFrame(rows, ALN), Params(tags=tags)).select("qname").collect()
    names = [r[0] for r in rows]
    return sorted(names.index(r[0]) for r in out)


def test_masks(spark):
    assert masks(spark, ("F1",)) == [1, 5, 9, 15]
    assert masks(spark, ("F1", "F2", "R1", "R2")) == [1, 4, 5, 6, 9, 15]


def test_orientation_and_swap(spark):
    d = spark.createDataFrame([(f,) for f in (99, 147, 83, 163, 67, 115)], "flag int")
    assert [r[0] for r in d.select(x.orientation(F.col("flag"))).collect()] == ["FR", "FR", "RF", "RF", "FF", "RR"]
    one = spark.createDataFrame([("q_F1_AAAA_F2_NA_R1_CCCC_R2_NA", "c", 0, 60, 83, "1M", "A", "I")], ALN)
    assert filters.tagged_reads(one, Params()).first()["tag"] == "CCCC"


def test_filters(spark):
    name = "q_F1_AAAA_F2_NA_R1_CCCC_R2_NA"
    rows = [(name, "c", 0, q, f, "1M", "A", "I") for q, f in ((10, 99), (60, 99), (60, 147), (60, 99 + 1024), (60, 97), (60, 115))]
    d = spark.createDataFrame(rows, ALN)
    n = lambda **k: filters.tagged_reads(d, Params(**k)).count()
    assert (n(), n(mapq=20), n(reverse=False), n(forward=False), n(orientations=("RR",)), n(regions=("d",)), n(regions=("d", "all"))) == (4, 3, 2, 2, 1, 0, 4)


def test_params():
    for bad in ({"mapq": 61}, {"threshold": 0.5}, {"coverage": 0}, {"distance": -1}, {"cluster": "x"}, {"tags": ("X",)}, {"forward": False, "reverse": False}, {"orientations": ("FF",), "forward": False}, {"orientations": ("RR",), "reverse": False}):
        with pytest.raises(ValueError):
            Params(**bad)
    assert any(line.startswith("threshold") for line in Params().lines())


def test_tags(spark):
    d = spark.createDataFrame([("ACGT", "ACG"), ("ACGT", "CGT"), ("A" * 2 + "CGTACGTACGTACGTA", "x")], "a string, b string")
    got = d.select(x.tag16(F.col("a")).alias("a"), x.tag16(F.col("b")).alias("b"), x.tag_key(F.col("a")).alias("k")).withColumn("d", F.levenshtein("a", "b")).collect()
    assert [r["d"] for r in got[:2]] == [2, 1]
    assert got[2]["a"] == "CGTACGTACGTACGTA"[::-1] and len(got[2]["k"]) == 16
    assert got[2]["b"] == "N" * 16


def test_chain_of_tags(spark):
    tags = [("c", 1, t, 1) for t in ("AAAAAAAA", "AAAAAATT", "AAAATTTT", "GGGGGGGG")]
    d = spark.createDataFrame(tags, "region string, block_id long, tag string, n_reads long").withColumns({"tag16": x.tag16(F.col("tag")), "tag_key": x.tag_key(F.col("tag"))}).drop("tag")
    got = {(r["tag16"], r["allele_key"]) for r in cluster.tag_components(d, 2).collect()}
    keys = {k for _, k in got}
    assert len(keys) == 2 and min(keys) == "0000000011111111"


def random_tags(spark, seed, many):
    r = random.Random(seed)
    tags = {("c", b, "".join(r.choice("ACGT") for _ in range(r.choice((4, 5, 8, 16))))) for b, k in ((1, many), (2, 9), (3, 1)) for _ in range(k)}
    near = {(c, b, t[:1] + r.choice("ACGT") + t[2:] if r.random() < 0.5 else t[1:] + "A") for c, b, t in tags}
    d = spark.createDataFrame([(*t, 1) for t in sorted(tags | near)], "region string, block_id long, tag string, n_reads long")
    return d.withColumns({"tag16": x.tag16(F.col("tag")), "tag_key": x.tag_key(F.col("tag"))}).drop("tag")


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 4, 5, 6, 16])
def test_tag_join_like_all_pairs(spark, distance):
    """The join on shortened tags, and the counts without pairs, against all pairs."""
    d = random_tags(spark, distance, 120)
    every = cluster.tag_pairs(d).withColumn("dist", F.levenshtein("tag_a", "tag_b")).collect()
    want = sorted((r["block_id"], r["key_a"], r["key_b"], r["dist"]) for r in every if r["dist"] <= distance)
    assert sorted((r["block_id"], r["key_a"], r["key_b"], r["dist"]) for r in cluster.tag_edges(d, distance).collect()) == want
    assert want or distance == 0
    assert tuple(cluster.pair_counts(d, distance).first()) == (len(every), sum(r["bound"] <= distance for r in every))


def test_components_of_large_blocks(spark, monkeypatch):
    """Labels in rounds are those of one task."""
    d = random_tags(spark, 7, 120)
    want = sorted(map(tuple, cluster.tag_components(d, 1).collect()))
    monkeypatch.setattr(cluster, "TASK_EDGES", 3)
    assert sorted(map(tuple, cluster.tag_components(d, 1).collect())) == want


def test_depth_over_bins(spark):
    """The sweep line in bins is the plain one."""
    r = random.Random(3)
    rows = [(r.choice("ab"), s, s + r.randrange(1, 60)) for s in (r.randrange(0, 300) for _ in range(200))]
    d = spark.createDataFrame(rows, "region string, start long, end long")
    got = {g["region"]: (g["start"], g["end"], g["n_reads"], g["max_depth"]) for g in blocks.depth(d, ["region"], 16).collect()}
    for k in "ab":
        own = [(s, e) for c, s, e in rows if c == k]
        assert got[k] == (min(s for s, _ in own), max(e for _, e in own), len(own), max(sum(s <= p < e for s, e in own) for p in range(400)))


def votes(spark, **counts):
    cov = sum(counts.values())
    row = {f"n_{b}": counts.get(b, 0) for b in "ATCGND"} | {f"q_{b}": 30 * counts.get(b, 0) for b in "ATCGND"} | {"cov": cov, "mapq_sum": 60 * cov}
    return calling.consensus(spark.createDataFrame([row]), 0.7).first()


def test_votes(spark):
    r = votes(spark, A=3, T=3)
    assert (r["base"], r["is_ambiguous"], r["is_conclusive"]) == ("N", True, False)
    r = votes(spark, A=1, T=1, C=8)
    assert (r["base"], r["is_ambiguous"], r["is_conclusive"], r["avg_C"], r["avg_G"], r["avg_mapq"]) == ("C", False, True, 30, 0, 60)
    r = votes(spark, N=6, A=1)
    assert (r["base"], r["is_ambiguous"]) == ("N", False)


def test_threshold_in_single_precision(spark):
    d = spark.createDataFrame([(10, 3), (10, 4)], "cov long, deviations long")
    assert [r["deviations"] for r in calling.allele_variants(d, 5, 0.7).collect()] == [4]


def sample(spark, cigars, seqs=None, quals=None, tag="ACGTACGT", start=0):
    rows = []
    for i, c in enumerate(cigars):
        n = sum(int(k) for k, o in __import__("re").findall(r"(\d+)([MIDSH])", c) if o in "MIS")
        rows.append((f"q{i}_F1_{tag}_F2_NA_R1_NA_R2_NA", "c", start, 60, 99, c, (seqs[i] if seqs else "A" * n), (quals[i] if quals else "I" * n)))
    ref = spark.createDataFrame([("c", p, "A") for p in range(60)], "region string, pos long, ref_base string")
    return Caller(spark.createDataFrame(rows, ALN), ref)


def test_insertion_stops_where_reads_lack_it(spark):
    c = sample(spark, ["5M2I5M"] * 4 + ["5M1I6M"], ["AAAAAGTAAAAA"] * 4 + ["AAAAAGAAAAAA"])
    got = [(r["insertion_index"], r["base"], r["n_G"], r["n_T"], r["n_D"]) for r in c.consensus.where("is_insertion").orderBy("insertion_index").collect()]
    assert got == [(0, "G", 5, 0, 0), (1, "T", 0, 4, 1)]
    line = formatting.lines(c.rows).first()["line"].split("\t")
    assert line[0] == "TMPVARCALL c" and line[2:6] == ["D", ".", "G,T", "2"]


def test_insertion_noise_and_end(spark):
    assert sample(spark, ["5M1I5M"] + ["10M"] * 4).consensus.count() == 0
    assert sample(spark, ["10M2I"] * 5).consensus.count() == 0


def test_missing_quality_is_all_n(spark):
    c = sample(spark, ["4M"] * 5, quals=["*"] * 5)
    got = {(r["base"], r["phred"]) for r in cigar.observed(c.allele_reads, 0, ["region"]).select("base", "phred").collect()}
    assert got == {("N", -1)}
    assert c.positions.count() == 4  # masked letters count as deviations


def test_cigars(spark):
    d = spark.createDataFrame([("2H3S4M2D5M1I3M",)], "cigar string")
    ops = d.select(F.explode(cigar.operations(F.col("cigar"))).alias("o")).select("o.*").collect()
    assert [(r["op"], r["ref_off"], r["query_off"]) for r in ops] == [("H", 0, 0), ("S", 0, 0), ("M", 0, 3), ("D", 4, 7), ("M", 6, 7), ("I", 11, 12), ("M", 11, 13)]
    assert d.select(cigar.reference_length(F.col("cigar"))).first()[0] == 14
    bad = spark.createDataFrame([("4=2M",)], "cigar string")
    with pytest.raises(Exception, match="unknown CIGAR"):
        bad.select(cigar.checked(F.col("cigar"))).collect()
    assert bad.select(cigar.checked(F.col("cigar"), True)).first()[0] == "4M2M"


def test_summary(spark):
    d = spark.createDataFrame([(v,) for v in (1, 2, 3, 4, 10)], "v long")
    s = stats.summary(d, "v").first()
    assert (s["n"], s["q1"], s["q2"], s["q3"], s["mean"], s["var"]) == (5, 2, 3, 4, 4.0, 10.0)
    assert set(stats.summary(d.where("v > 99"), "v").first().asDict().values()) == {0}


def test_histogram_cap(spark):
    d = spark.createDataFrame([(12,), (10,), (1,)], "n long")
    assert {(r["bucket"], r["n"]) for r in stats.histogram(d, "n").collect()} == {(0, 1), (10, 1), (1, 1)}


def test_two_alleles_one_mutated(spark):
    rows = [(f"q{i}_F1_{'ACGTACGT' if i < 5 else 'GGGGTTTT'}_F2_NA_R1_NA_R2_NA", "c", 0, 60, 99, "6M", "AAAAAA" if i < 5 else "AAATAA", "IIIIII") for i in range(10)]
    ref = spark.createDataFrame([("c", p, "A") for p in range(10)], "region string, pos long, ref_base string")
    r = Caller(spark.createDataFrame(rows, ALN), ref).rows.collect()
    assert len(r) == 1 and (r[0]["pos"], r[0]["ref_alleles"], r[0]["alt_alleles"], r[0]["n_alleles"]) == (3, "A", "T", 2)


def test_order_and_partitioning_do_not_matter(spark, data):
    from tagcall.queries import caller

    c = caller(spark, data)
    other = Caller(c.alignments.orderBy(F.xxhash64("qname")).repartition(7), c.reference)
    rows = lambda d: sorted(r["line"] for r in formatting.lines(d.rows).collect())
    assert rows(c) == rows(other)


def test_empty(spark):
    c = Caller(spark.createDataFrame([], ALN), spark.createDataFrame([], "region string, pos long, ref_base string"))
    assert c.rows.count() == 0
    assert contigs.contig_catalog(c.alignments).count() == 0


def test_report(spark, data):
    from tagcall.operators.report import report
    from tagcall.queries import caller

    text = report(caller(spark, data))
    assert [line.split()[1] for line in text.splitlines() if line.startswith("====")] == ["Summary", "Clustering", "Reference", "Global", "Variants"]
    assert text.splitlines()[-1].startswith("CRC32  0x")


@pytest.mark.parametrize("phred", [0, 25])
def test_votes_like_rows_of_bases(spark, phred):
    """Array sums against one row for each observed base, also with clips, missing and short qualities, and groups over batches."""
    from tagcall.operators import votes

    r = random.Random(phred)
    rows = []
    for i in range(300):
        ops = r.choice(["12M", "3S9M", "4M2D8M", "5M3I4M", "2H12M", "6M1D1I5M", "1S3M1D4M2I2M"])
        rows.append((r.choice("ab"), r.randrange(3), 40 + r.randrange(30), r.choice([0, 7, 60]), ops, "".join(r.choice("ACGTNR") for _ in range(12)), r.choice(["*", "".join(chr(33 + r.randrange(42)) for _ in range(12))])))
    d = spark.createDataFrame(rows, "region string, block_id long, start long, mapq long, cigar string, seq string, qual string").repartition(3)
    keep = ["region", "block_id"]
    sums = [F.count("*").alias("cov"), F.sum("mapq").alias("mapq_sum"), *(F.count_if(F.col("base") == b).alias(f"n_{b}") for b in x.PRINTED), *(F.sum(F.when(F.col("base") == b, F.col("phred")).otherwise(0)).alias(f"q_{b}") for b in x.PRINTED)]
    want = cigar.observed(d, phred, [*keep, "mapq"]).groupBy(*keep, "pos").agg(*sums)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = sorted(map(tuple, votes.base_votes(d, phred, keep).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(map(tuple, want.collect())) and votes.base_votes(d.limit(0), phred, keep).count() == 0


@pytest.fixture
def many_parts(spark):
    """A hundred shuffle partitions that stay apart, and no broadcast that isn't asked for."""
    conf = {"spark.sql.shuffle.partitions": "100", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_blocks_of_a_hot_start(spark, many_parts):
    """Half of all reads begin at one position: blocks are right, and no task has more than a fiftieth of the rows."""
    r = random.Random(2)
    spans = sorted([(5000, 5030)] * 10_000 + [(s, s + r.randrange(5, 60)) for s in (r.randrange(3_000_000) for _ in range(10_000))])
    want, top, n = {}, None, 0
    for a, b in spans:
        n += top is None or a >= top + 10
        top, want[a] = b if top is None else max(top, b), n
    d = blocks.with_blocks(spark.createDataFrame([(f"r{i}", "c", a, b) for i, (a, b) in enumerate(spans)], "qname string, region string, start long, end long"))
    d = d.select("start", "block_id", F.spark_partition_id().alias("task")).toPandas()
    assert len(d) == 20_000 and (d["start"].map(want) == d["block_id"]).all()
    assert d["task"].value_counts().max() <= 400


@pytest.mark.parametrize("n", [0, 1, 2, 7, 3000])
def test_ranks_over_parts(spark, many_parts, n):
    """Quartiles where values lie in many parts."""
    r = random.Random(n)
    v = sorted(r.randrange(-500, 500) for _ in range(n))
    got = stats.summary(spark.createDataFrame([(x,) for x in v], "v long"), "v").first()
    assert [got[c] for c in ("n", "min", "q1", "q2", "q3", "max", "sum")] == [n, *((v[0], v[n // 4], v[2 * n // 4], v[3 * n // 4], v[-1]) if v else [0] * 5), sum(v)]


@pytest.mark.parametrize("kind", ["star", "chain", "random"])
def test_components_by_stars(spark, many_parts, kind):
    """A star of 10^5 leaves whose centre is neither first nor last, a chain of 10^4 in any order, and random graphs of two keys."""
    from tagcall.operators.components import components

    spark.conf.set("spark.sql.shuffle.partitions", "16")
    r = random.Random(5)
    if kind == "star":
        edges = spark.range(100_000).where("id <> 50000").select(F.lit("c").alias("region"), F.lit(50_000).cast("long").alias("a"), F.col("id").alias("b"))
        got = components(edges, ["region"])
        assert got.count() == 100_000 and got.select("label").distinct().collect() == [(0,)]
        return
    if kind == "chain":
        names = list(range(10_000))
        r.shuffle(names)
        pairs, want = [("c", a, b) for a, b in zip(names[:-1], names[1:], strict=True)], {("c", i): 0 for i in range(10_000)}
    else:
        pairs = [(k, r.randrange(400), r.randrange(400)) for k in "ab" for _ in range(260)]
        up = {}
        root = lambda x: x if up.setdefault(x, x) == x else root(up[x])
        for k, a, b in pairs:
            if a != b:
                a, b = root((k, a)), root((k, b))
                up[max(a, b)] = min(a, b)
        want = {x: root(x)[1] for x in up}
    rows = components(spark.createDataFrame(pairs, "region string, a long, b long"), ["region"]).collect()
    assert len(rows) == len(want) and {(x["region"], x["node"]): x["label"] for x in rows} == want


def test_join_of_a_hot_key(spark, many_parts):
    """Rows of a key that holds a third of them stay spread over the tasks that had them."""
    from tagcall.operators.components import spread_join

    rows = spark.range(30_000, numPartitions=60).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), "id")
    keys = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    d = spread_join(rows, keys, ["k"], 30_000).select("k", "top", F.spark_partition_id().alias("task")).toPandas()
    assert len(d) == 30_000 and (d.loc[d["k"] == -1, "top"] == 29_997).all() and d["task"].value_counts().max() <= 30_000 / 50


def test_display_of_an_allele(spark):
    from tagcall.operators import display

    ref = spark.createDataFrame([("c", i, "ACGTACGTACGT"[i]) for i in range(12)], "region string, pos long, ref_base string")
    seqs = [("8M", 0, "ACGTACGT"), ("4M2I4M", 0, "ACGTGGACGT"), ("4M1I4M", 0, "ACGTGACTT"), ("2M2D6M", 0, "ACACGTAC"), ("3S6M", 2, "TTTGTACGA")]
    rows = [(f"q{i}_F1_ACGTACGT_F2_NA_R1_NA_R2_NA", "c", pos, 60, 99, ops, seq, "I" * len(seq)) for i, (ops, pos, seq) in enumerate(seqs)]
    run = Caller(spark.createDataFrame(rows, ALN), ref)
    tag = "TGCATGCANNNNNNNN"
    assert display.display_allele(run, "c", 1, 1).splitlines() == [
        "allele 1 of block 1 in c: 0 to 10, 5 reads, depth 5",
        "         0 reference             ACGT**ACGTAC",
        f"         0 FR F {tag} ....**....",
        f"         0 FR F {tag} ....gg....",
        f"         0 FR F {tag} ....g*..T.",
        f"         0 FR F {tag} ..--**......",
        f"         2 FR F {tag}   ..**...A",
    ]
    assert len(display.display_allele(run, "c", 1, 1, most=2).splitlines()) == 4 and display.display_allele(run, "c", 1, 9) is None
    assert display.blocks_text(run, 1).first()["text"] == "block 1 in c: 0 to 10, 10 positions, 5 reads, depth 5\n  0 8 q0_F1_ACGTACGT_F2_NA_R1_NA_R2_NA 8M"
    assert display.clusters_text(run).first()["text"] == f"clusters of block 1 in c\n  {tag}, 5 reads of 1 tags <- {tag}*5"
