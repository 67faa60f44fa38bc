"""The command line on files, against the same run from tables."""

import pytest

from tagcall.__main__ import main, params, parser
from tagcall.operators import formatting
from tagcall.queries import caller
from tagcall.sources import bam


def test_options():
    a = parser().parse_args("-i x.bam -f y.fa -m 10 -b 0.8 -r chr1 -r chr2 -u F1 -u R1 -O FR -F".split())
    p = params(a)
    assert (p.mapq, p.threshold, p.regions, p.tags, p.orientations, p.forward, p.reverse) == (10, 0.8, ("chr1", "chr2"), ("F1", "R1"), ("FR",), True, False)
    with pytest.raises(ValueError):
        params(parser().parse_args("-i x -f y -F -R".split()))


def test_rows_from_files(spark, data, tmp_path, capsys):
    c = caller(spark, data)
    rows = [tuple(r) for r in c.alignments.select("qname", "region", "pos", "mapq", "flag", "cigar", "seq", "qual").orderBy("region", "pos").collect()]
    bam.write_bam(rows, [(f"chr{i}", 10_000) for i in range(1, 6)], str(tmp_path / "x.bam"))
    letters: dict[str, list[str]] = {}
    for r in c.reference.orderBy("region", "piece").collect():
        letters.setdefault(r["region"], []).append(bytes(r["letters"]).decode())
    (tmp_path / "x.fa").write_text("".join(f">{n}\n{''.join(s)}\n" for n, s in letters.items()))
    assert main(["-i", str(tmp_path / "x.bam"), "-f", str(tmp_path / "x.fa"), "-C", "dbscan", "-T"]) == 0
    got = [line for line in capsys.readouterr().out.splitlines() if line.startswith("TMPVARCALL")]
    order = ["contig_idx", "block_id", "pos", "is_insertion", "pool_allele"]
    assert got == [r["line"] for r in formatting.lines(c.rows).orderBy(*order).collect()]


def test_header_order(spark, tmp_path, capsys):
    """Rows come in the order of the header, not of the names; an unknown contig is an error."""
    names, rows = ["chr2", "chr10", "chr1"], []
    for n in names:
        for i in range(6):
            seq = "A" * 4 + "G" + "A" * 15
            rows.append((f"q{i}_F1_ACGTACGT_F2_NA_R1_NA_R2_NA", n, 100, 60, 99, "20M", seq, "I" * 20))
    bam.write_bam(rows, [(n, 1000) for n in names], str(tmp_path / "x.bam"))
    (tmp_path / "x.fa").write_text("".join(f">{n}\n{'A' * 1000}\n" for n in names))
    args = ["-i", str(tmp_path / "x.bam"), "-f", str(tmp_path / "x.fa"), "-T"]
    assert main(args) == 0
    lines = [line.split() for line in capsys.readouterr().out.splitlines() if line.startswith("TMPVARCALL")]
    assert [next(w for w in line if w in names) for line in lines] == names
    assert main([*args, "-r", "chr7"]) == 2
    assert main(["-i", args[1], "-f", args[3], "-vvvv"]) == 0
    views = [line for line in capsys.readouterr().out.splitlines() if line.startswith(("block 1", "clusters of", "allele 1"))]
    assert [next(w for w in line.replace(":", "").split() if w in names) for line in views] == names * 3  # blocks, clusters, alleles in order
