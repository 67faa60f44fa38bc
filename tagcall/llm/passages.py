"""Substring dedup by compact windows.

A text is its sequence of five-word shingles.  Under one hash function the nodes of the sequence's
Cartesian tree are its compact windows: all runs between ``left`` and ``right`` that hold shingle
``c`` have c as their min-hash.  Windows of ``MIN_SHINGLES`` (50 words) or more number about
2 n / MIN_SHINGLES.

1. Windows of the ``FIRST`` functions whose min-hash another text has too cut the regions out of each
   text that can hold a shared passage (at similarity 0.8 all of them differ with 0.2 ** FIRST, 0.16 %).
2. In the regions, the windows of ``FUNCTIONS`` functions are joined as intervals, two functions at a
   time: where both overlap, the runs share two min-hashes, which are the key of that interval.
3. Members of a key meet its leader, in rounds.  Of a pair of texts the intervals of all keys are swept
   together; a pair goes on if some place is covered by ``NEED`` keys or more (of ``KEYS``; a passage
   at similarity 0.8 has fewer with 0.4 %).  It is verified on the regions' shingles themselves:
   passages of MIN_SHINGLES or more with Jaccard similarity ``SIMILARITY`` or more.
4. Members with a run in a verified passage lead no more, but stay for leaders to come, as what is like
   them need not be like their leader.  Nor do members of which more than half of every run lies in
   verified passages, or that stand ``BESIDE`` one verified with their own key's leader: there a copy
   differs from its original, and both are in the result.  Runs that equal the other text's, shingle for shingle, are left to
   the text of the smaller number.  Leaders leave, as they have met the whole key; so do members of which
   no place has NEED keys left.  A member compared with its leader, but far from it at a key (no run that the
   leader nearly holds), leads that key no more.  Instead it leads keys made of the leader and a shingle that the
   leader has not: two texts far from one leader that share a passage share such a shingle, so a family meets in
   the groups of its common changes, not all with all.  Only keys that some open member can lead go on.  Texts are
   numbered so that those whose windows are common, the ones with fewest changes, lead.  Rounds go on until no key has a leader and another member.  A key of more
   than ``HEAVY`` members is split by each other key at its place, so by four min-hashes: a pair with
   NEED keys meets there still.  No cap on members or partners, and never all pairs of a key at once.
   What was verified of a text goes on as one row for each place where a passage begins, so no row of a
   leader grows with its members.

Texts with one word sequence are one node, so exact copies never meet each other.

Null or empty texts and those of fewer than 50 words have no passages.  Rows that repeat an id are
rows of their own; an empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.components import spread_join
from ._matching import Pair, Sequence, both_ways, equal_runs, merged
from ._spark import BROADCAST_BYTES, hot_keys, salted_join, saved, small, table
from ._text import U, chunks, fingerprints, mix, powers, shingles, words

SHINGLE = 5
MIN_WORDS = 50
MIN_SHINGLES = MIN_WORDS - SHINGLE + 1
SIMILARITY = 0.8
FUNCTIONS = 16
KEYS = FUNCTIONS // 2
FIRST = 4
NEED = 2
#: Shingles between a member and a passage shared with its leader, at most, for it to be part of the same copy.
BESIDE = 2 * MIN_SHINGLES
#: Members of a key beyond which it is split.
HEAVY = 64
#: Leaders that a key's members meet in the first, second and later rounds.
LEADERS = (1, 8, 64, 512)
#: Values between two regions of a text, so that no verified run reaches over; more than a run may miss.
GAP = 8
_AT = U((1 << 32) - 1)
_BITS = 29
_PLACE = (1 << _BITS) - 1


def node_ids(w: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit id of each text's word sequence."""
    f1, f2 = fingerprints(w, off)
    return mix(f1 ^ mix(f2)).view(np.int64)


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """The minimum of v[i : i + width] for every i."""
    if len(v) < width:
        return v[:0]
    m, w = v, 1
    while 2 * w <= width:
        m = np.minimum(m[: len(m) - w], m[w:])
        w *= 2
    n = len(v) - width + 1
    return np.minimum(m[:n], m[width - w : width - w + n])


def ordering(h: np.ndarray, seed: int) -> np.ndarray:
    """A hash function's order of the shingles; never 0."""
    return mix(h ^ U(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) | U(1 << 63)


def compact_windows(h: np.ndarray, off: np.ndarray, seed: int, width: int = MIN_SHINGLES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, c, left, right) of the compact windows of ``width`` or more under one hash function, in order of c.

    Only positions that are the minimum of some run of ``width`` can have such a window, and the
    nearest smaller positions that bound one are of that kind too, so the tree is built on those.
    """
    n_texts = len(off) - 1
    doc = np.repeat(np.arange(n_texts), np.diff(off))
    v = np.zeros(len(h) + n_texts + 1, U)  # a 0 stands before, between and after texts
    at = np.arange(len(h)) + doc + 1
    v[at] = (ordering(h, seed) & ~_AT) | at.astype(U)
    low = sliding_min(v, width)
    if len(low):
        low = low[np.concatenate([[True], low[1:] != low[:-1]])]
    spots = np.unique((low[low > 0] & _AT).astype(np.int64))
    walls = np.flatnonzero(v == 0)
    spots = np.sort(np.concatenate([spots, walls]))
    value, place = v[spots].tolist(), spots.tolist()
    left, right, stack = [0] * len(place), [0] * len(place), []
    for i, x in enumerate(value):
        while stack and value[stack[-1]] > x:
            right[stack.pop()] = place[i] - 1
        left[i] = place[stack[-1]] + 1 if stack else place[i]
        stack.append(i)
    left, right = np.array(left), np.array(right)
    keep = (v[spots] > 0) & (right - left + 1 >= width)
    c, left, right = spots[keep], left[keep], right[keep]
    text = np.searchsorted(walls, c) - 1
    begin = walls[text] + 1
    return text, c - begin, left - begin, right - begin


def owned_runs(h: np.ndarray, off: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, c) of each compact window: the runs of MIN_SHINGLES in it that hold c, by where they begin in h.

    Every run has one minimum, so the windows part all runs of a text among them, in order.
    """
    text, c, left, right = compact_windows(h, off, seed)
    begin = off[:-1][text]
    first = np.maximum(left, c - MIN_SHINGLES + 1)
    last = np.minimum(right, c + MIN_SHINGLES - 1) - MIN_SHINGLES + 1
    return first + begin, last + begin, c + begin


def keyed_windows(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, packed interval) of all joined windows of two functions each.

    Packed: the number of the two functions, and where the interval of runs begins and ends in the text.
    Of intervals of a text that are alike, shingle for shingle, the first.
    """
    texts, keys, packed, content = [], [], [], []
    power = powers(len(h) + 1)
    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(h) * power[:-1])])
    back = powers(len(h) + 1, U(pow(int(power[1]) if len(h) else 1, -1, 1 << 64)))
    for k in range(KEYS):
        (first_a, last_a, c_a), (first_b, last_b, c_b) = owned_runs(h, off, 2 * k + 1), owned_runs(h, off, 2 * k + 2)
        at = np.union1d(first_a, first_b)
        a, b = np.searchsorted(first_a, at, "right") - 1, np.searchsorted(first_b, at, "right") - 1
        end = np.minimum(last_a[a], last_b[b]) + MIN_SHINGLES
        text = np.searchsorted(off, at, "right") - 1
        texts.append(text)
        keys.append(mix(mix(h[c_a[a]] + U(k + 1)) + h[c_b[b]]))
        packed.append((k << 2 * _BITS) | (at - off[text] << _BITS) | (end - off[text]))
        content.append((total[end] - total[at]) * back[at] + (end - at).astype(U))
    text, key, pos, same = (np.concatenate(x) for x in (texts, keys, packed, content))
    order = np.lexsort((pos, same, key, text))
    text, key, pos, same = text[order], key[order], pos[order], same[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1]) | (same[1:] != same[:-1])
    return text[new], key[new].view(np.int64), pos[new]


def unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Function, begin and end of packed intervals."""
    return packed >> 2 * _BITS, packed >> _BITS & _PLACE, packed & _PLACE


def depth(begin: np.ndarray, end: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each interval of runs, the greatest sum of weights of the intervals that hold one of its runs of MIN_SHINGLES."""
    last = end - MIN_SHINGLES
    at, place = np.unique(np.concatenate([begin, last + 1]), return_inverse=True)
    step = np.zeros(len(at), np.int64)
    np.add.at(step, place, np.concatenate([weight, -weight]))
    total = np.cumsum(step)
    first, stop = place[: len(begin)], np.searchsorted(at, last, "right")
    return np.maximum.reduceat(np.append(total, 0), np.stack([first, stop], 1).ravel())[::2]


def _lists(flat: np.ndarray, text: np.ndarray, n_texts: int) -> pa.ListArray:
    """Values in order of their text as one list for each text."""
    return pa.ListArray.from_arrays(np.searchsorted(text, np.arange(n_texts + 1)).astype(np.int32), pa.array(flat))


def _nodes(rows: DataFrame) -> DataFrame:
    """(doc_id, th, nid, n_words, keys, places): min-hashes of the windows of the FIRST functions, and their runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(zip(*(c.to_pylist() for c in batch.columns), strict=True), 2):
                ids, th, texts = zip(*part, strict=True)
                w, off = words(list(texts))
                h, s_off = shingles(w, off, SHINGLE)
                found = [owned_runs(h, s_off, k + 1) for k in range(FIRST)]
                key = np.concatenate([mix(h[c] + U(100 + k)) for k, (_, _, c) in enumerate(found)]).view(np.int64)
                first, last = (np.concatenate([f[i] for f in found]) for i in (0, 1))
                text = np.searchsorted(s_off, first, "right") - 1
                place = (first - s_off[text] << _BITS) | (last - s_off[text] + MIN_SHINGLES)
                order = np.argsort(text, kind="stable")
                lists = [_lists(x[order], text[order], len(ids)) for x in (key, place)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(th, pa.int64()), pa.array(node_ids(w, off)), pa.array(np.diff(off)), *lists], ["doc_id", "th", "nid", "n_words", "keys", "places"])

    return rows.mapInArrow(run, "doc_id long, th long, nid long, n_words long, keys array<long>, places array<long>")


def _regions(found: DataFrame) -> DataFrame:
    """(nid, of_id, of_th, places) with merged places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(3):
                p = x.values.to_numpy()
                begin, end = merged(p >> _BITS, p & _PLACE)
                out.append((begin << _BITS | end).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.list_(pa.int64()))], ["nid", "of_id", "of_th", "places"])

    return found.select("nid", "of_id", "of_th", "places").mapInArrow(run, "nid long, of_id long, of_th long, places array<long>")


_HELD = "nid long, keys array<long>, pos array<long>, grams binary, starts array<long>, offs array<long>"


def _held(rows: DataFrame) -> DataFrame:
    """Rows (nid, places, text) to keyed intervals, and the regions' shingles (32 bits each) with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(zip(*(c.to_pylist() for c in batch.columns), strict=True), 2):
                nids, places, texts = zip(*part, strict=True)
                h, off = shingles(*words(list(texts)), SHINGLE)
                p = np.array([x for one in places for x in one])
                text = np.repeat(np.arange(len(part)), [len(x) for x in places])
                begin, size = p >> _BITS, (p & _PLACE) - (p >> _BITS)
                r_off = np.concatenate([[0], np.cumsum(size)])
                cut = h[np.repeat(off[text] + begin - r_off[:-1], size) + np.arange(r_off[-1])]
                region, key, packed = keyed_windows(cut, r_off)
                packed = packed + (begin[region] << _BITS) + begin[region]
                order = np.argsort(text[region], kind="stable")
                lists = [_lists(x[order], text[region][order], len(part)) for x in (key, packed)]
                # the regions of a text one after another, with a gap of values of its own after each
                padded = (mix(np.arange(GAP * len(p), dtype=U) + np.repeat(np.array(nids).view(U)[text], GAP)) >> U(32)).astype("<u4").reshape(-1, GAP)
                low = (cut >> U(32)).astype("<u4")
                grams, starts, offs = [], [], []
                at = np.searchsorted(text, np.arange(len(part) + 1))
                for i in range(len(part)):
                    own = range(at[i], at[i + 1])
                    grams.append(b"".join(low[r_off[j] : r_off[j + 1]].tobytes() + padded[j].tobytes() for j in own))
                    starts.append(begin[at[i] : at[i + 1]])
                    n = size[at[i] : at[i + 1]] + GAP
                    offs.append(np.cumsum(n) - n)
                kind = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(nids, pa.int64()), *lists, pa.array(grams, pa.binary()), pa.array(starts, kind), pa.array(offs, kind)], ["nid", "keys", "pos", "grams", "starts", "offs"])

    return rows.select("nid", "places", "text").mapInArrow(run, _HELD)


_JUDGED = "a long, b long, a_met boolean, b_met boolean, spans array<struct<a0: long, a1: long, b0: long, b1: long, similarity: double>>, same array<struct<b0: long, b1: long>>"
#: loose: runs that the other text nearly holds, but in no verified passage; rest: each side's shingles that its leader has not.
_RESTS = _JUDGED + ", loose array<struct<of_a: boolean, lo: long, hi: long>>, rest_a binary, rest_b binary"
_SIDE = ["grams", "starts", "offs"]
#: Bytes of shingles that a worker keeps sorted at hand.
_KEPT = 1 << 24


class Regions(Sequence):
    """The regions' shingles of a text, and the place of each in the text (-1 between regions)."""

    def __init__(self, grams: bytes, starts: np.ndarray, offs: np.ndarray):
        super().__init__(np.frombuffer(grams, "<u4"))
        self.starts, self.offs = starts, offs
        size = np.diff(np.append(offs, len(self.h)))
        self.at = np.arange(len(self.h)) + np.repeat(starts - offs, size)
        self.at[(offs + size)[:, None] - 1 - np.arange(GAP)] = -1

    def placed(self, lo: int, hi: int) -> tuple[int, int]:
        """A stretch of the regions as one of the text."""
        k = int(np.searchsorted(self.offs, lo, "right")) - 1
        stop = (int(self.offs[k + 1]) if k + 1 < len(self.offs) else len(self.h)) - GAP
        shift = int(self.starts[k] - self.offs[k])
        return lo + shift, min(hi, stop) + shift


def left_of(own: Regions, lead: Regions, met: np.ndarray, spans: list[tuple[int, int]], similarity: float) -> tuple[list[tuple[int, int]], bytes]:
    """What the leader leaves of a text, at the places where they met (packed): runs loosely held, and (shingle, place) of what it has not.

    Two texts that met a leader share what a passage of theirs needs with it, or a shingle that it has not: a run
    with fewer shingles in the leader than a passage needs, and enough in a third text, holds one of the third text's.
    """
    hit = Pair(own, lead).hit
    need = int(np.ceil(MIN_SHINGLES * 2 * similarity / (1 + similarity) - 1e-9))
    total = np.concatenate([[0], np.cumsum(hit)])
    run = own.at[np.flatnonzero(total[MIN_SHINGLES:] - total[:-MIN_SHINGLES] >= need)]
    for lo, hi in spans:
        run = run[(run < lo) | (run + MIN_SHINGLES > hi)]
    loose = []
    if len(run):
        lo, hi = merged(run, run + 1)
        loose = list(zip(lo.tolist(), (hi - 1 + MIN_SHINGLES).tolist(), strict=True))
    begin, end = met >> _BITS, met & _PLACE
    place = own.at[~hit]
    k = np.searchsorted(begin, place, "right") - 1
    inside = (k >= 0) & (place < end[k])
    return loose, np.stack([own.h[~hit][inside], place[inside].astype("<u4")], 1).tobytes()


def _verify(pairs: DataFrame, similarity: float) -> DataFrame:
    """Rows (a, b, a_met, b_met, where they met, regions of both) to verified spans, b's equal runs, and what leaders leave, in shingles."""
    span = pa.struct([("a0", pa.int64()), ("a1", pa.int64()), ("b0", pa.int64()), ("b1", pa.int64()), ("similarity", pa.float64())])
    equal = pa.struct([("b0", pa.int64()), ("b1", pa.int64())])
    held = pa.struct([("of_a", pa.bool_()), ("lo", pa.int64()), ("hi", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, Regions] = {}
        size = 0
        for batch in batches:
            ids = [batch.column(i).to_pylist() for i in (0, 1)]
            mets = [batch.column(i).to_pylist() for i in (2, 3)]
            spans, same, loose, rest = [], [], [], ([], [])
            for i in range(batch.num_rows):
                loose.append([])
                sides = []
                for k, nids in zip((6, 9), ids, strict=True):
                    if nids[i] not in kept:
                        if size > _KEPT:
                            kept.clear()
                            size = 0
                        kept[nids[i]] = Regions(batch.column(k)[i].as_py(), *(batch.column(k + j)[i].values.to_numpy() for j in (1, 2)))
                        size += len(kept[nids[i]].h) * 4
                    sides.append(kept[nids[i]])
                x, y = sides
                found = [(*x.placed(lo, hi), *y.placed(lo_b, hi_b), j) for lo, hi, lo_b, hi_b, j in both_ways(x, y, MIN_SHINGLES, similarity)]
                spans.append([dict(zip(("a0", "a1", "b0", "b1", "similarity"), f, strict=True)) for f in found])
                same.append([dict(zip(("b0", "b1"), y.placed(lo, hi), strict=True)) for lo, hi in equal_runs(x, y, MIN_SHINGLES)] if found else [])
                for k in (0, 1):
                    rest[k].append(None)
                    if mets[k][i]:
                        runs, rest[k][-1] = left_of(sides[k], sides[1 - k], batch.column(4 + k)[i].values.to_numpy(), [f[2 * k : 2 * k + 2] for f in found], similarity)
                        loose[-1] += [{"of_a": k == 0, "lo": lo, "hi": hi} for lo, hi in runs]
            cols = [pa.array(spans, pa.list_(span)), pa.array(same, pa.list_(equal)), pa.array(loose, pa.list_(held)), *(pa.array(r, pa.binary()) for r in rest)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *cols], ["a", "b", "a_met", "b_met", "spans", "same", "loose", "rest_a", "rest_b"])

    return pairs.select("a", "b", "a_met", "b_met", "a_at", "b_at", *(f"{c}_{s}" for s in "ab" for c in _SIDE)).mapInArrow(run, _RESTS)


def _swept(pairs: DataFrame) -> DataFrame:
    """Rows (a, b, met) to the pairs of which some place is covered by NEED keys.

    a_met, b_met: whether the other was the leader of one of its keys; a_at, b_at: where.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int64())
        for batch in batches:
            met = batch.column(2)
            off = met.offsets.to_numpy() - met.offsets[0].as_py()
            of_a, pos, bits = (met.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("of_a", "pos", "bits"))
            weight, (_, begin, end) = np.bitwise_count(bits).astype(np.int64), unpack(pos)
            keep, sides = [], ([], [])
            for i in range(batch.num_rows):
                own = slice(off[i], off[i + 1])
                a_met, b_met = bool(of_a[own].any()), not of_a[own].all()
                # swept where all places are in one text, so on one scale
                keep.append(a_met == b_met or bool(depth(begin[own], end[own], weight[own]).max() >= NEED))
                for side, some, rows in zip(sides, (a_met, b_met), (of_a[own], ~of_a[own]), strict=True):
                    lo, hi = merged(begin[own][rows], end[own][rows]) if some and keep[-1] else (begin[:0], end[:0])
                    side.append(lo << _BITS | hi)
            met = [pa.array([len(x) > 0 for x in side]) for side in sides]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *met, *(pa.array(side, kind) for side in sides)], ["a", "b", "a_met", "b_met", "a_at", "b_at"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long, a_met boolean, b_met boolean, a_at array<long>, b_at array<long>")


def _candidates(meets: DataFrame) -> DataFrame:
    """Pairs (a, b, met) that meet under NEED keys or more; meets has (nid, pos, bits, lead)."""
    low, high = F.least("nid", "lead"), F.greatest("nid", "lead")
    met = F.collect_list(F.struct((F.col("nid") == low).alias("of_a"), "pos", "bits")).alias("met")
    return meets.groupBy(low.alias("a"), high.alias("b")).agg(F.bit_or("bits").alias("all"), met).where(F.bit_count("all") >= NEED).select("a", "b", "met")


def deepened(key: np.ndarray, pos: np.ndarray, bits: np.ndarray, open_: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, ...]:
    """A node's members, where each of a heavy key gives way to its joins with those of the other keys.

    Two heavy ones are joined once; the joined key is the same whichever of the two was heavy.
    """
    f, begin, end = unpack(pos)
    rows = [(key[~heavy], pos[~heavy], bits[~heavy], open_[~heavy])]
    for i in np.flatnonzero(heavy).tolist():
        lo, hi = np.maximum(begin, begin[i]), np.minimum(end, end[i])
        j = np.flatnonzero((f != f[i]) & (~heavy | (f > f[i])) & (hi - lo >= MIN_SHINGLES))
        own, other = np.broadcast_to(key[i], len(j)).view(U), key[j].view(U)
        first = f[j] < f[i]
        joined = mix(mix(np.where(first, own, other)) + np.where(first, other, own)).view(np.int64)
        rows.append((joined, f[i] << 2 * _BITS | lo[j] << _BITS | hi[j], bits[j] | bits[i], open_[j] & open_[i]))
    return tuple(np.concatenate(c) for c in zip(*rows, strict=True))


def remaining(rows: tuple[np.ndarray, ...], leads: tuple[np.ndarray, np.ndarray], spans: np.ndarray, same: np.ndarray, loose: np.ndarray, judged: np.ndarray) -> tuple[np.ndarray, ...]:
    """A node's members (key, pos, bits, open) of the next round, from those (and heavy) of this one and what was verified.

    leads: row and leader of each meeting; spans: rows (begin, end, leader or 0) of verified passages; same:
    (begin, end) of the runs that another text stands for; loose: rows (begin, end, leader) of the runs that a
    leader nearly holds; judged: the leaders that the text was compared with.  An open member far from such a leader
    leads no more: it is a row (leader, pos, 0, True), and what the leader has not of it makes keys of its own.
    """
    key, pos, bits, open_, heavy = rows
    f, begin, end = unpack(pos)
    open_ = open_.copy()
    for lo, hi, other in spans.tolist():
        inside = np.minimum(end, hi) - np.maximum(begin, lo)
        open_ &= inside < MIN_SHINGLES
        met = leads[0][leads[1] == other]
        open_[met[inside[met] >= -BESIDE]] = False
    if len(spans):
        edge = np.stack(merged(spans[:, 0], spans[:, 1]), 1)
        total = np.cumsum(edge[:, 1] - edge[:, 0])
        level = np.stack([total - edge[:, 1] + edge[:, 0], total], 1)
        known = np.interp(end, edge.ravel(), level.ravel()) - np.interp(begin, edge.ravel(), level.ravel())
        open_ &= end - begin - known > MIN_SHINGLES // 2
    far = open_[leads[0]] & np.isin(leads[1], judged)
    for lo, hi, other in loose.tolist():
        far &= (leads[1] != other) | (np.minimum(end, hi) - np.maximum(begin, lo) < MIN_SHINGLES)[leads[0]]
    away, at = np.zeros(len(key), bool), np.full(len(key), np.iinfo(np.int64).max)
    away[leads[0][far]] = True
    np.minimum.at(at, leads[0][far], leads[1][far])
    lead = np.where(away, at, 0)
    open_ &= ~away
    for lo, hi in same.tolist():  # the runs that are left: none, or those before or after
        first, last = end - MIN_SHINGLES >= lo, begin + MIN_SHINGLES <= hi
        before, after = first & last & (begin < lo), first & last & (end > hi)
        end = np.where(before & ~after, lo - 1 + MIN_SHINGLES, np.where(first & last & ~before & ~after, begin, end))
        begin = np.where(after & ~before, hi - MIN_SHINGLES + 1, begin)
    left = end - begin >= MIN_SHINGLES
    key, bits, open_, heavy, lead, f, begin, end = (c[left] for c in (key, bits, open_, heavy, lead, f, begin, end))
    pos = f << 2 * _BITS | begin << _BITS | end
    held = None
    for last in (False, True):
        if len(key):
            stay = depth(*unpack(pos)[1:], np.bitwise_count(bits).astype(np.int64)) >= NEED
            key, pos, bits, open_, heavy = (c[stay] for c in (key, pos, bits, open_, heavy))
            lead = lead if last else lead[stay]
        if held is None:
            held = np.unique(np.stack([lead, pos & (1 << 2 * _BITS) - 1], 1)[lead != 0], axis=0)
        heavy = heavy & (np.bitwise_count(bits) == 1)
        if last or not heavy.any():
            break
        key, pos, bits, open_ = deepened(key, pos, bits, open_, heavy)
        heavy = np.zeros(len(key), bool)
    n = len(held)
    return tuple(np.concatenate(c) for c in zip((key, pos, bits, open_), (held[:, 0], held[:, 1], np.zeros(n, np.int64), np.ones(n, bool)), strict=True))


_SPAN, _SAME, _LOOSE, _JUDGE = range(4)
_MEMBERS = "key long, nid long, pos long, bits long, open boolean"


def _remaining(nodes: DataFrame) -> DataFrame:
    """Members of the next round from rows (nid, m, s): a node's members, and what was verified of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for nid, m, s in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                rows = tuple(m.values.field(c).to_numpy(zero_copy_only=False) for c in ("key", "pos", "bits", "open", "heavy"))
                met = m.values.field("leads")
                leads = np.repeat(np.arange(len(met)), np.diff(met.offsets.to_numpy())), met.flatten().to_numpy()
                found, kind = np.zeros((0, 3), np.int64), np.zeros(0, np.int32)
                if s.is_valid:
                    found = np.stack([s.values.field(c).to_numpy() for c in ("lo", "hi", "other")], 1)
                    kind = s.values.field("kind").to_numpy()
                key, *rest = remaining(rows, leads, found[kind == _SPAN], found[kind == _SAME, :2], found[kind == _LOOSE], found[kind == _JUDGE, 2])
                if len(key):
                    out.append((key, np.full(len(key), nid), *rest))
            cols = [np.concatenate(c) for c in zip(*out, strict=True)] or [np.empty(0, np.int64)] * 4 + [np.empty(0, bool)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "nid", "pos", "bits", "open"])

    return nodes.select("nid", "m", "s").mapInArrow(run, _MEMBERS)


def _leaders(members: DataFrame, round_: int) -> DataFrame:
    """(key, lead, n): up to so many open members of each key as the round has leaders; n members in all."""
    slots = LEADERS[min(round_, len(LEADERS) - 1)]
    slot = F.pmod(F.xxhash64("nid", F.lit(round_)), F.lit(slots)) if slots > 1 else F.lit(0)
    by_slot = members.groupBy("key", slot.alias("slot")).agg(F.min(F.when(F.col("open"), F.col("nid"))).alias("lead"), F.min("nid").alias("low"), F.max("nid").alias("high"), F.count("*").alias("n"))
    if slots == 1:
        return saved(by_slot.where("lead IS NOT NULL AND low <> high").select("key", "lead", "n"), f"passage-leaders-{round_}")
    by_slot = saved(by_slot, f"passage-slots-{round_}")
    whole = by_slot.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).where("low <> high").select("key", "n")
    return saved(by_slot.where("lead IS NOT NULL").select("key", "lead").join(whole, "key"), f"passage-leaders-{round_}")


def _meets(members: DataFrame, leaders: DataFrame) -> DataFrame:
    """Members and the leaders of their keys; where the leaders are many, members of hot keys stay where they are."""
    if leaders.count() * 24 <= BROADCAST_BYTES:
        return members.join(F.broadcast(leaders), "key")
    return spread_join(members, leaders, ["key"], members.count())  # fewer than 1,000 hot keys, each with as many leaders as slots


def _verified(judged: DataFrame) -> DataFrame:
    """(nid, lo, hi, other, same) of both texts of each pair: the furthest passage from each place on, for each leader
    that the text met (0: the other text leads none of its keys), and the runs that another text stands for."""
    spans = judged.select("a", "b", "a_met", "b_met", F.explode("spans").alias("s"))
    sides = [spans.select(F.col(x).alias("nid"), F.col(f"s.{x}0").alias("lo"), F.col(f"s.{x}1").alias("hi"), F.when(F.col(f"{x}_met"), F.col(y)).otherwise(0).alias("other"), F.lit(False).alias("same")) for x, y in ("ab", "ba")]
    equal = judged.select("b", F.explode("same").alias("s")).select(F.col("b").alias("nid"), F.col("s.b0").alias("lo"), F.col("s.b1").alias("hi"), F.lit(0).cast("long").alias("other"), F.lit(True).alias("same"))
    far = sides[0].unionByName(sides[1]).groupBy("nid", "lo", "other", "same").agg(F.max("hi").alias("hi"))
    return far.unionByName(equal.distinct())


def _known(new: DataFrame) -> DataFrame:
    """(nid, s): of each text all of ``_verified``, what leaders loosely hold, and the leaders that it was compared with."""
    verified = _verified(new).select("nid", "lo", "hi", "other", F.col("same").cast("int").alias("kind"))
    loose = new.select("a", "b", F.explode("loose").alias("s")).select(F.when(F.col("s.of_a"), F.col("a")).otherwise(F.col("b")).alias("nid"), "s.lo", "s.hi", F.when(F.col("s.of_a"), F.col("b")).otherwise(F.col("a")).alias("other"), F.lit(_LOOSE).alias("kind"))
    zero = F.lit(0).cast("long")
    judges = [new.where(f"{x}_met").select(F.col(x).alias("nid"), zero.alias("lo"), zero.alias("hi"), F.col(y).alias("other"), F.lit(_JUDGE).alias("kind")) for x, y in ("ab", "ba")]
    return verified.unionByName(loose).unionByName(judges[0]).unionByName(judges[1]).groupBy("nid").agg(F.collect_list(F.struct("lo", "hi", "other", "kind")).alias("s"))


def rest_keys(lead: int, rest: bytes, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, place, open) of what a leader has not of a text: open inside the intervals (packed) that are far from it."""
    pair = np.frombuffer(rest, "<u4").reshape(-1, 2)
    place = pair[:, 1].astype(np.int64)
    open_ = np.zeros(len(pair), bool)
    if len(far):
        begin, end = merged(far >> _BITS & _PLACE, far & _PLACE)
        k = np.searchsorted(begin, place, "right") - 1
        open_ = (k >= 0) & (place < end[k])
    key = mix(mix(np.array([lead]).view(U)) + pair[:, 0].astype(U)).view(np.int64)
    order = np.lexsort((~open_, key))
    new = np.append(True, np.diff(key[order]) != 0)[: len(key)]
    return key[order][new], place[order][new], open_[order][new]


def _rests(rows: DataFrame) -> DataFrame:
    """Rows (nid, lead, rest, far) to members of the keys that a leader and a shingle that it has not make."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for nid, lead, rest, far in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                key, place, open_ = rest_keys(lead, rest, far.values.to_numpy() if far.is_valid else np.empty(0, np.int64))
                pos = np.maximum(place - MIN_SHINGLES + 1, 0) << _BITS | (place + MIN_SHINGLES)
                out.append((key, np.full(len(key), nid), pos, np.full(len(key), (1 << KEYS) - 1), open_))
            cols = [np.concatenate(c) for c in zip(*out, strict=True)] or [np.empty(0, np.int64)] * 4 + [np.empty(0, bool)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "nid", "pos", "bits", "open"])

    return rows.select("nid", "lead", "rest", "far").mapInArrow(run, _MEMBERS)


def _next_members(left: DataFrame, new: DataFrame, round_: int) -> DataFrame:
    """Members of keys that some open member can lead, from what is left of this round's and what its leaders have not."""
    out = saved(left, f"passage-open-{round_}")
    far = saved(out.where("bits = 0").groupBy("nid", F.col("key").alias("lead")).agg(F.collect_set("pos").alias("far")), f"passage-far-{round_}")
    rest = new.where("b_met").select(F.col("b").alias("nid"), F.col("a").alias("lead"), F.col("rest_b").alias("rest")).unionByName(new.where("a_met").select(F.col("a").alias("nid"), F.col("b").alias("lead"), F.col("rest_a").alias("rest")))
    own = rest.join(small(far, 100), ["nid", "lead"])
    every = rest.join(small(saved(far.select("lead").distinct(), f"passage-left-{round_}"), 8), "lead", "left_semi").join(small(far, 100), ["nid", "lead"], "left")
    out = out.where("bits <> 0")
    keys = saved(out.where("open").select("key").union(_rests(own).where("open").select("key")).distinct(), f"passage-open-keys-{round_}")
    return saved(out.unionByName(_rests(every)).join(small(keys, 8), "key", "left_semi").select("key", "nid", "pos", "bits", "open"), f"passage-members-{round_}")


def _number(nid: Column, common: Column) -> Column:
    """A text's number among those that share windows: small where its windows are common, so that the text with the
    fewest changes of a family leads it; the other 56 bits are of its id."""
    level = F.least(F.floor(8 * F.log2(1 + common)), F.lit(255))
    return F.shiftleft((127 - level).cast("long"), 56).bitwiseOR(nid.bitwiseAND((1 << 56) - 1))


def passage_links(rows: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(nodes of all rows, verified spans between nodes); rows has doc_id, th, text."""
    every = saved(_nodes(rows), "passage-nodes")
    nodes = every.select("doc_id", "th", "nid", "n_words")
    windows = every.select("nid", F.explode(F.arrays_zip("keys", "places")).alias("w")).select("nid", F.col("w.keys").alias("key"), F.col("w.places").alias("place"))
    shared = saved(windows.groupBy("key").agg(F.min("nid").alias("a"), F.max("nid").alias("b"), F.count("*").alias("n")).where("a <> b").select("key", "n"), "passage-keys")
    found = windows.join(small(shared, 24), "key").groupBy("nid").agg(F.collect_set("place").alias("places"), F.sum("n").alias("n"))
    of = every.groupBy("nid").agg(F.min(F.struct("doc_id", "th")).alias("of"), F.max(F.size("keys")).alias("size"))
    numbers = saved(found.join(of, "nid").select("nid", _number(F.col("nid"), F.col("n") / F.col("size")).alias("number"), "of", "places"), "passage-numbers")
    regions = saved(_regions(numbers.select(F.col("number").alias("nid"), F.col("of.doc_id").alias("of_id"), F.col("of.th").alias("of_th"), "places")), "passage-regions")
    texts = rows.join(small(regions, 100), (rows["th"] == regions["of_th"]) & rows["doc_id"].eqNullSafe(regions["of_id"])).select("nid", "places", "text")
    held = saved(_held(texts), "passage-held")
    if held.count() > regions.count():  # rows that repeat id and text
        held = saved(held.dropDuplicates(["nid"]), "passage-held-once")

    members = held.select("nid", F.explode(F.arrays_zip("keys", "pos")).alias("w")).select(F.col("w.keys").alias("key"), "nid", F.col("w.pos").alias("pos"))
    members = members.select("key", "nid", "pos", F.expr(f"shiftleft(1L, cast(shiftright(pos, {2 * _BITS}) AS int))").alias("bits"), F.lit(True).alias("open"))
    judged = rows.sparkSession.createDataFrame([], _RESTS)
    for round_ in count():
        meets = saved(_meets(members, _leaders(members, round_)), f"passage-meets-{round_}")
        if not meets.limit(1).count():
            break
        met = pairs = saved(_swept(_candidates(meets.where("nid <> lead"))).join(judged.select("a", "b"), ["a", "b"], "left_anti"), f"passage-pairs-{round_}")
        for s, by, hot in [("a", "b", hot_keys(pairs, "a")), ("b", "a", hot_keys(pairs, "b"))]:
            own = held.join(small(saved(met.select(F.col(s).alias("nid")).distinct(), f"passage-met-{round_}"), 24), "nid", "left_semi")
            pairs = salted_join(pairs, own.select(F.col("nid").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in _SIDE)), s, by, hot)
        new = saved(_verify(pairs, similarity), f"passage-judged-{round_}")
        judged = judged.union(new)
        heavy = (F.col("n") > HEAVY).alias("heavy")
        if LEADERS[min(round_, len(LEADERS) - 1)] == 1:
            left = meets.where("nid <> lead").select("key", "nid", "pos", "bits", "open", heavy, F.array("lead").alias("leads"))
        else:
            left = meets.groupBy("key", "nid", "pos", "bits", "open", heavy).agg(F.collect_list("lead").alias("leads")).where(~F.array_contains("leads", F.col("nid")))
        left = left.groupBy("nid").agg(F.collect_list(F.struct("key", "pos", "bits", "open", "heavy", "leads")).alias("m"))
        members = _next_members(_remaining(left.join(_known(new), "nid", "left")), new, round_)
    ids = small(saved(numbers.select("nid", "number"), "passage-ids"), 32)
    links = judged.select("a", "b", F.explode("spans").alias("s"))
    for number, nid in (("a", "nid"), ("b", "lead")):
        links = links.join(ids.select(F.col("number").alias(number), F.col("nid").alias(nid)), number)
    return nodes, links.select("nid", "lead", F.col("s.a0").alias("a0"), (F.col("s.a1") + SHINGLE - 1).alias("a1"), F.col("s.b0").alias("b0"), (F.col("s.b1") + SHINGLE - 1).alias("b1"), "s.similarity")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Passages (doc_id, begin, end, keep_id, kept, similarity) that other documents hold as well, in words.

    Passages of a document that overlap are joined.  ``keep_id`` is the smallest id of a document
    that stands for the passage, and ``kept`` says whether it stands for it here.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("th"), docs[text_col].alias("text"))
    nodes, links = passage_links(rows, similarity)
    own = saved(nodes.where(F.col("n_words") >= MIN_WORDS).groupBy("nid").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"), F.max("n_words").alias("n_words")), "passage-own-ids")
    copies = own.where("n > 1").select("nid", F.col("nid").alias("lead"), F.lit(0).cast("long").alias("begin"), F.col("n_words").alias("end"), F.lit(1.0).alias("similarity"))
    a = links.select("nid", "lead", F.col("a0").alias("begin"), F.col("a1").alias("end"), "similarity")
    b = links.select(F.col("lead").alias("nid"), F.col("nid").alias("lead"), F.col("b0").alias("begin"), F.col("b1").alias("end"), "similarity")
    every = a.union(b).join(own.select(F.col("nid").alias("lead"), F.col("low").alias("lead_id")), "lead").select("nid", "begin", "end", "lead_id", "similarity")
    every = every.union(copies.join(own.select("nid", F.col("low").alias("lead_id")), "nid").select("nid", "begin", "end", "lead_id", "similarity"))
    every = saved(every.groupBy("nid", "begin", "end").agg(F.min("lead_id").alias("lead_id"), F.max("similarity").alias("similarity")), "passage-spans")
    w = Window.partitionBy("nid").orderBy("begin", "end")
    new = (F.col("begin") > F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int")
    runs = every.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    merged_ = runs.groupBy("nid", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.min("lead_id").alias("keep_id"), F.max("similarity").alias("similarity"))
    out = nodes.select("doc_id", "nid").join(saved(merged_, "passage-merged"), "nid")
    keep = F.least("keep_id", F.coalesce("doc_id", "keep_id"))
    return out.select(F.col("doc_id").alias(id_col), "begin", "end", keep.alias("keep_id"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), "similarity")


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
