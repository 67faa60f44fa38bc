"""File formats give back what was written; filters reach the BAM reader."""

import random

import pytest

from tagcall.operators import reference
from tagcall.queries import caller
from tagcall.sources import bai, bam, fasta, sam

COLUMNS = ["qname", "region", "pos", "mapq", "flag", "cigar", "seq", "qual"]


def whole(pieces):
    """Letters of each contig, whose pieces have no gaps."""
    got: dict[str, str] = {}
    for r in pieces.orderBy("region", "piece").collect():
        assert r["piece"] * reference.PIECE == len(got.setdefault(r["region"], ""))
        got[r["region"]] += bytes(r["letters"]).decode()
    return got


@pytest.fixture(scope="module")
def rows(spark, data):
    return sorted(tuple(r) for r in caller(spark, data).alignments.select(*COLUMNS).collect())


def test_sam(spark, data, rows, tmp_path):
    (tmp_path / "x.sam").mkdir()
    sam.write_sam(caller(spark, data).alignments, str(tmp_path / "x.sam/part"))
    (tmp_path / "head.sam").write_text("@HD\tVN:1.6\n@SQ\tSN:chr2\tLN:9\n@SQ\tSN:chr1\tLN:9\nq\t4\t*\t0\t0\t*\t*\t0\t0\tacg\t*\n")
    assert sorted(tuple(r) for r in sam.read_sam(spark, str(tmp_path / "x.sam/part")).collect()) == rows
    assert sam.header_contigs(spark, str(tmp_path / "head.sam")) == ["chr2", "chr1"]
    assert tuple(sam.read_sam(spark, str(tmp_path / "head.sam")).first()) == ("q", None, -1, 0, 4, "*", "ACG", "*")


def test_fasta(spark, tmp_path):
    r = random.Random(1)
    want = {f"c{i}": "".join(r.choice("acgtn") for _ in range(r.randrange(0, 400))) for i in range(6)}
    path = tmp_path / "x.fa"
    path.write_text("".join(f">{n} text\n" + "".join(s[i : i + 17] + "\n" for i in range(0, len(s), 17)) + "\n" for n, s in want.items()))
    assert whole(fasta.read_pieces(spark, str(path))) == {n: s.upper() for n, s in want.items() if s}


@pytest.mark.parametrize("split", [1 << 30, 4000])
def test_bam(spark, rows, tmp_path, split):
    path = str(tmp_path / "x.bam")
    bam.write_bam(rows, [(f"chr{i}", 10_000) for i in range(1, 6)], path, block=3000)
    df = bam.load(spark, path, split)
    assert sorted(tuple(r) for r in df.collect()) == rows
    some = df.where("region = 'chr2' AND mapq >= 40")
    assert some.count() == sum(r[1] == "chr2" and r[3] >= 40 for r in rows)


def test_fasta_of_several_files(spark, tmp_path):
    r = random.Random(2)
    want = {n: "".join(r.choice("ACGT") for _ in range(k)) for n, k in (("cA", 2250), ("cB", 1980), ("cC", 700))}
    for n, s in want.items():
        (tmp_path / f"{n}.fa").write_text(f">{n}\n" + "".join(s[i : i + 60] + "\n" for i in range(0, len(s), 60)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1000)
    try:
        got = whole(fasta.read_reference(spark, str(tmp_path)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want


def test_fasta_index(spark, tmp_path, monkeypatch):
    """Pieces by index, of one contig only its own bytes; and what is written is read again, with and without the index."""
    r = random.Random(3)
    want = {n: "".join(r.choice("acgtn") for _ in range(k)) for n, k in (("cA", 70_001), ("cB", 65_536), ("cC", 1), ("cD", 200_000))}
    path, index = tmp_path / "x.fa", []
    with open(path, "w", newline="") as f:
        for n, s in want.items():
            f.write(f">{n} text\r\n")
            index.append((n, len(s), f.tell(), 70, 72))
            f.write("".join(s[i : i + 70] + "\r\n" for i in range(0, len(s), 70)))
    (tmp_path / "x.fa.fai").write_text("".join("\t".join(map(str, e)) + "\n" for e in index))
    upper = {n: s.upper() for n, s in want.items()}
    monkeypatch.setattr(fasta, "TASK_PIECES", 2)
    df = fasta.read_reference(spark, str(path))
    assert whole(df) == upper and whole(df.where("region = 'cB'")) == {"cB": upper["cB"]}
    reader = fasta.FastaReader(str(path))
    reader.regions = {"cD"}
    assert [(p.entry[0], p.first, p.end) for p in reader.partitions()] == [("cD", 0, 2), ("cD", 2, 4)]
    fasta.write_fasta(df, str(tmp_path / "out/y.fa"))
    assert whole(fasta.read_reference(spark, str(tmp_path / "out/y.fa"))) == upper == whole(fasta.read_pieces(spark, str(tmp_path / "out/y.fa")))
    (tmp_path / "x.fa.fai").write_text("cA\t70001\n")
    with pytest.raises(ValueError, match="not an index"):
        fasta.read_index(str(path))


def test_pieces_of_rows(spark):
    """Rows with gaps, over two pieces; and slices over their border."""
    at = [0, 1, 5, reference.PIECE - 1, reference.PIECE, reference.PIECE + 3]
    rows = spark.createDataFrame([("c", p, "acgtac"[i]) for i, p in enumerate(at)], "region string, pos long, ref_base string").repartition(3)
    got = {r["piece"]: bytes(r["letters"]).decode() for r in reference.pieces(rows).collect()}
    assert got == {0: "AC   G" + " " * (reference.PIECE - 7) + "T", 1: "A  C"}
    blocks = spark.createDataFrame([("c", 1, 0, 6), ("c", 2, reference.PIECE - 1, reference.PIECE + 4), ("c", 3, 7, 7)], "region string, block_id long, start long, end long")
    assert {r["block_id"]: r["ref_seq"] for r in reference.slices(rows, blocks).collect()} == {1: "ACG", 2: "TAC"}


def test_damaged_bam(spark, rows, tmp_path):
    path = tmp_path / "x.bam"
    bam.write_bam(rows, [(f"chr{i}", 10_000) for i in range(1, 6)], str(path), block=3000)
    bam.register(spark)
    whole = path.read_bytes()
    assert whole.endswith(bam.END) and spark.read.format("bam").load(str(path)).count() == len(rows)
    starts = [i for i in range(len(whole)) if bam.block_size(whole[i : i + 18])]
    flipped = bytearray(whole)
    flipped[starts[3] - 8] ^= 1  # a checksum
    bad = [whole[: -len(bam.END)], whole[: starts[2]], whole[: starts[2] + 9] + bam.END, whole[: starts[2]] + bam.END, bytes(flipped)]
    for i, b in enumerate(bad):
        (tmp_path / f"{i}.bam").write_bytes(b)
        with pytest.raises(Exception, match="cut off|no whole BGZF block|ends inside a record|damaged BGZF block"):
            spark.read.format("bam").load(str(tmp_path / f"{i}.bam")).collect()


@pytest.fixture(scope="module")
def indexed(rows, tmp_path_factory):
    """The same reads in one file with an index and one without, sorted, with unplaced reads at the end."""
    folder = tmp_path_factory.mktemp("bam")
    placed = sorted(rows, key=lambda r: (r[1], r[2]))
    every = [*placed, *((f"u{i}", None, -1, 0, 4, "*", "ACGT", "*") for i in range(20))]
    contigs = [*((f"chr{i}", 10_000) for i in range(1, 6)), ("empty", 500)]
    for name, index in (("with", True), ("without", False)):
        bam.write_bam(every, contigs, str(folder / f"{name}.bam"), block=700, index=index)
    return folder, every


def plain_scan(path, monkeypatch, split=1 << 30, **bounds):
    """Rows of the reader in this process, the number of blocks that it inflated for them, and of its ranges."""
    reader = bam.BamReader(str(path), split)
    vars(reader).update(bounds)
    parts, n, inflate = reader.partitions(), 0, bam.inflate

    def counted(block):
        nonlocal n
        n += 1
        return inflate(block)

    monkeypatch.setattr(bam, "inflate", counted)
    out = [r for p in parts for r in reader.read(p)]
    monkeypatch.setattr(bam, "inflate", inflate)
    return out, n, len(parts)


@pytest.mark.parametrize("split", [1 << 30, 3000])
def test_indexed_region_reads_only_its_blocks(indexed, monkeypatch, split):
    folder, every = indexed
    whole, blocks, _ = plain_scan(folder / "without.bam", monkeypatch)
    assert whole == every
    for region in ("chr1", "chr2", "chr5"):
        want = [r for r in every if r[1] == region]
        got, few, parts = plain_scan(folder / "with.bam", monkeypatch, split, regions={region})
        assert got == want and few <= blocks / 5 + 2 + 2 * parts and (parts == 1 or split == 3000)
        assert plain_scan(folder / "without.bam", monkeypatch, split, regions={region})[0] == want
    assert plain_scan(folder / "with.bam", monkeypatch, regions={"empty"}) == ([], 0, 0)
    assert plain_scan(folder / "with.bam", monkeypatch, split)[0] == every  # unplaced reads too


def test_indexed_positions(monkeypatch, tmp_path):
    """Bounds of positions over several windows and bins; long reads that begin before a span are not its own."""
    r = random.Random(7)
    rows = [(f"q{i}", "c", p, 60, 0, f"{n}M", "A" * n, "I" * n) for i, p in enumerate(sorted(r.randrange(900_000) for _ in range(3000))) for n in [r.choice([20, 60, 400])]]
    bam.write_bam(rows, [("b", 10), ("c", 1_000_000), ("d", 10)], str(tmp_path / "x.bam"), block=2000, index=True)
    whole = plain_scan(tmp_path / "x.bam", monkeypatch)[1]
    for begin, end in ((0, 1), (16_384, 32_768), (100_000, 100_500), (131_071, 131_073), (500_000, None), (899_000, 2_000_000)):
        got, blocks, _ = plain_scan(tmp_path / "x.bam", monkeypatch, regions={"c"}, begin=begin, end=end)
        want = [x for x in rows if x[2] >= begin and (end is None or x[2] < end)]
        assert [x for x in got if end is None or x[2] < end] == want
        assert blocks <= whole * (((end or 900_000) - begin) / 900_000 + 0.2)


def test_indexed_through_spark(spark, indexed):
    folder, every = indexed
    df = bam.load(spark, (folder / "with.bam").as_uri(), 3000)
    some = df.where("region IN ('chr2', 'chr4') AND pos >= 40 AND pos < 120 AND mapq >= 30")
    assert sorted(map(tuple, some.collect())) == sorted(r for r in every if r[1] in ("chr2", "chr4") and 40 <= r[2] < 120 and r[3] >= 30)
    assert df.where("region = 'empty'").count() == 0 == df.where("region = 'nowhere'").count()
    assert df.where("region IS NULL").count() == 20
    assert df.where("region = 'chr1'").count() < df.count() == len(every)  # filters of one use don't reach another
    found = bam.indexed_catalog(spark, str(folder / "with.bam"), 1).collect()
    counts = {f"chr{i}": sum(r[1] == f"chr{i}" for r in every) for i in range(1, 6)}
    assert [(r["contig_idx"], r["region"], r["length"], r["num_reads"]) for r in found] == [(i, n, 10_000, counts[n]) for i, n in enumerate(counts)]
    assert bam.indexed_catalog(spark, str(folder / "without.bam")) is None
    assert bam.indexed_catalog(spark, str(folder / "with.bam")).count() == 6


def test_damaged_index(indexed, tmp_path):
    folder, _ = indexed
    data = (folder / "with.bam.bai").read_bytes()
    for bad, says in ((b"XAI\x01" + data[4:], "not a BAM index"), (data[:90], "cut off")):
        (tmp_path / "x.bai").write_bytes(bad)
        with pytest.raises(ValueError, match=says):
            bai.read_index(str(tmp_path / "x.bam"))


@pytest.mark.parametrize(("begin", "end", "number"), [(0, 1, 4681), (16_383, 16_385, 585), (0, 1 << 29, 0), (1 << 26, (1 << 26) + 1, 4681 + 4096), (131_071, 131_073, 73)])
def test_bins(begin, end, number):
    assert bai.bin_of(begin, end) == number and any(number in r for r in bai.overlapping(begin, end))


def test_stream(spark, tmp_path):
    from tagcall.streaming.blocks import stream_blocks

    one = spark.createDataFrame([("c", 0, 30), ("c", 40, 70), ("c", 79, 90), ("d", 5, 9)], "region string, start long, end long")
    one.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([("z", 900_000, 900_010)], one.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(one.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_blocks(stream).writeStream.outputMode("append").format("memory").queryName("blocks_out").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("blocks_out").collect()}
    assert {("c", 0, 30, 1), ("c", 40, 90, 2), ("d", 5, 9, 1)} == {g for g in got if g[0] != "z"}
