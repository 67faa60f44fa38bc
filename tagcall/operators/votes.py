"""Votes of reads without a row for each observed base: a batch of reads is decoded as arrays, and a row goes on for each group and position.

Bases, masks and missing qualities count as in ``cigar.observed``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.exprs import DELETED_PHRED, PRINTED

_CODE = np.full(256, PRINTED.index("N"))
for _b in "ATCG":
    _CODE[ord(_b)] = PRINTED.index(_b)
_N, _D, _ALL = PRINTED.index("N"), PRINTED.index("D"), len(PRINTED)
COUNTS, SUMS = [f"n_{b}" for b in PRINTED], [f"q_{b}" for b in PRINTED]


@lru_cache(1 << 14)
def covered(cigar: str) -> np.ndarray:
    """Rows (place in the reference, place in the read, length, deleted?) of the runs that cover positions."""
    r = q = 0
    out = []
    for n, op in re.findall(r"(\d+)([MIDSH])", cigar):
        n = int(n)
        if op in "MD" and n:
            out.append((r, q, n, op == "D"))
        r, q = r + n * (op in "MD"), q + n * (op in "MIS")
    return np.array(out, np.int64).reshape(-1, 4)


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts and where each begins and how long it is."""
    size = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer("".join(texts).encode("latin-1", "replace"), np.uint8), np.cumsum(size) - size, size


def _taken(data: tuple[np.ndarray, np.ndarray, np.ndarray], row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte at a place of each row's text, and whether there is one."""
    text, begin, size = data
    there = at < size[row]
    return text[np.where(there, begin[row] + at, 0)] if len(text) else np.zeros(len(row), np.uint8), there


def _cells(group: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (group, pos), and which of them each entry is.

    Groups' spans lie one after another, without a sort; a batch whose groups are thinly covered is sorted.
    """
    if not len(pos):
        return group, pos, pos
    n = int(group.max()) + 1
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(low, group, pos)
    np.maximum.at(high, group, pos)
    width = np.where(high >= low, high - low + 1, 0)
    base = np.cumsum(width) - width
    if int(width.max()) > len(pos) or int(width.sum()) > len(pos):
        first = int(low.min())
        span = int(high.max()) - first + 1
        keys, inverse = np.unique(group * span + pos - first, return_inverse=True)
        return keys // span, keys % span + first, inverse
    at = base[group] + pos - low[group]
    found = np.flatnonzero(np.bincount(at, minlength=int(width.sum())))
    number = np.zeros(int(width.sum()), np.int64)
    number[found] = np.arange(len(found))
    owner = np.searchsorted(base + width, found, "right")
    return owner, found - base[owner] + low[owner], number[at]


def tally(group: np.ndarray, start: np.ndarray, cigars: list[str], seqs: list[str], quals: list[str], mapq: np.ndarray, phred: int) -> dict[str, np.ndarray]:
    """Sums for each (group, position) that a read covers."""
    runs = [covered(c) for c in cigars]
    row = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
    ref, query, n, deleted = np.concatenate([*runs, np.empty((0, 4), np.int64)]).T
    of = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    r, gone = row[of], deleted[of].astype(bool)
    pos, at = start[r] + ref[of] + within, query[of] + within
    base, there = _taken(_letters(seqs), r, at)
    letter = np.where(gone, _D, np.where(there, _CODE[base], _N))
    q, there = _taken(_letters(quals), r, at)
    missing = np.array([x == "*" for x in quals], bool)[r] | ~there
    q = np.where(gone, DELETED_PHRED, np.where(missing, -1, q.astype(np.int64) - 33))
    letter = np.where(~gone & (q < phred), _N, letter)
    owner, place, inverse = _cells(group[r], pos)
    cell, m = inverse * _ALL + letter, len(owner)
    counts = np.bincount(cell, minlength=m * _ALL).reshape(m, _ALL)
    sums = np.bincount(cell, q, m * _ALL).reshape(m, _ALL).astype(np.int64)
    out = {"group": owner, "pos": place, "cov": counts.sum(1), "mapq_sum": np.bincount(inverse, mapq[r], m).astype(np.int64)}
    return out | {c: counts[:, i] for i, c in enumerate(COUNTS)} | {c: sums[:, i] for i, c in enumerate(SUMS)}


def base_votes(reads: DataFrame, phred: int, keep: list[str]) -> DataFrame:
    """(keep, pos, cov, mapq_sum, n_A .. n_D, q_A .. q_D) over reads (keep, start, cigar, seq, qual, mapq).

    Each batch is summed where it lies; a group that fills many batches has a row of each for a position, added up by the shuffle.
    """
    kinds = [(c, dict(reads.dtypes)[c], to_arrow_type(reads.schema[c].dataType)) for c in keep]
    names = ["pos", "cov", "mapq_sum", *COUNTS, *SUMS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *own, start, cigars, seqs, quals, mapq = (c.to_pylist() for c in batch.columns)
            place: dict[tuple, int] = {}
            group = np.array([place.setdefault(k, len(place)) for k in zip(*own, strict=True)], np.int64)
            t = tally(group, np.array(start, np.int64), cigars, seqs, quals, np.array(mapq, np.int64), phred)
            keys = [np.array(list(c), object)[t["group"]] if place else [] for c in zip(*place, strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(k, kind) for k, (_, _, kind) in zip(keys, kinds, strict=True)), *(pa.array(t[n], pa.int64()) for n in names)], [*keep, *names])

    made = reads.select(*keep, "start", "cigar", "seq", "qual", F.col("mapq").cast("long").alias("mapq"))
    schema = ", ".join([*(f"`{c}` {kind}" for c, kind, _ in kinds), *(f"{n} long" for n in names)])
    return made.mapInArrow(run, schema).groupBy(*keep, "pos").agg(*(F.sum(n).alias(n) for n in names[1:]))
