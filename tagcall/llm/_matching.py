"""Passages that two sequences of hashes share, by the Jaccard similarity of their stretches (numpy only)."""

from __future__ import annotations

from functools import cached_property

import numpy as np


class Sequence:
    """A sequence and what is worked out of it once: its order, ranks, and earlier places of each value."""

    def __init__(self, h: np.ndarray):
        self.h = h
        self.order = np.argsort(h, kind="stable")
        self.ordered = h[self.order]
        self.new = np.append(True, self.ordered[1:] != self.ordered[:-1]) if len(h) else np.empty(0, bool)
        self.repeats = not self.new.all()

    @cached_property
    def previous(self) -> np.ndarray:
        """Where each value stood last, -1 if nowhere."""
        out = np.full(len(self.h), -1)
        out[self.order[~self.new]] = self.order[:-1][~self.new[1:]]
        return out

    @cached_property
    def rank(self) -> np.ndarray:
        """The number of each ordered value among the different ones."""
        return np.cumsum(self.new) - 1

    @cached_property
    def places(self) -> np.ndarray:
        """Rank and place of each ordered value as one ascending number, and one more above all."""
        return np.append(self.rank * (len(self.h) + 1) + self.order, np.iinfo(np.int64).max)


class Pair:
    """Where each value of a stands in b, at first."""

    def __init__(self, a: Sequence, b: Sequence):
        self.a, self.b = a, b
        self.at = np.minimum(np.searchsorted(b.ordered, a.h), len(b.h) - 1)
        self.hit = b.ordered[self.at] == a.h
        self.place = b.order[self.at]
        self.plain = not (a.repeats or b.repeats)


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals, as intervals in order that do not touch."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], end[order]
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], begin[1:] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(end) - 1]])
    return begin[new], reach[last]


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    x, y = np.sort(x), np.sort(y)
    x, y = x[np.append(True, x[1:] != x[:-1])], y[np.append(True, y[1:] != y[:-1])]
    both = np.sort(np.concatenate([x, y]))
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared / (len(both) - shared)


def _alike(p: Pair, lo: int, hi: int, lo_b: int, hi_b: int) -> float:
    """The similarity of a's and b's stretches."""
    if not p.plain:
        return jaccard(p.a.h[lo:hi], p.b.h[lo_b:hi_b])
    at = p.place[lo:hi]
    both = int(np.count_nonzero(p.hit[lo:hi] & (at >= lo_b) & (at < hi_b)))
    return both / (hi - lo + hi_b - lo_b - both)


def _exact(p: Pair, begins: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray, j: np.ndarray, width: int) -> None:
    """Right the similarities of stretches, where a value stands twice in either."""
    before = np.lib.stride_tricks.sliding_window_view(p.a.previous, width)[begins]
    at = lo_b[:, None] + np.arange(int((hi_b - lo_b).max()))
    first_b = (at < hi_b[:, None]) & (p.b.previous[np.minimum(at, len(p.b.h) - 1)] < lo_b[:, None])
    wrong = np.flatnonzero((before >= begins[:, None]).any(1) | (first_b.sum(1) < hi_b - lo_b))
    if not len(wrong):
        return
    # a's value stands in b's stretch if its first place there from lo_b on is before hi_b
    window = begins[wrong, None] + np.arange(width)
    first_a = before[wrong] < begins[wrong, None]
    base = p.b.rank[p.at][window] * (len(p.b.h) + 1)
    nearest = p.b.places[np.searchsorted(p.b.places, base + lo_b[wrong, None])]
    both = (first_a & p.hit[window] & (nearest < base + hi_b[wrong, None])).sum(1)
    j[wrong] = both / (first_a.sum(1) + first_b[wrong].sum(1) - both)


def _widened(p: Pair, lo: np.ndarray, hi: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of b with what surrounds them and a holds as well, up to ``width``."""
    walls = np.concatenate([[-1], np.flatnonzero(~np.isin(p.b.h, p.a.h)), [len(p.b.h)]])
    hi = np.maximum(hi, np.minimum(walls[np.searchsorted(walls, hi)], lo + width))
    return np.minimum(lo, np.maximum(walls[np.searchsorted(walls, lo) - 1] + 1, hi - width)), hi


def _stretches(p: Pair, begins: np.ndarray, width: int, similarity: float) -> list[tuple]:
    """Spans, as of ``matching``, that hold every stretch of ``width`` from ``begins`` that is verified."""
    if not len(begins):
        return []
    far = len(p.b.h) + 4 * width
    own = np.sort(np.lib.stride_tricks.sliding_window_view(np.where(p.hit, p.place, far), width)[begins], axis=1)
    n, row = (own < far).sum(1), np.arange(len(begins))
    some = n > 0
    own, n, begins, row = own[some], n[some], begins[some], row[: some.sum()]
    if not len(begins):
        return []
    middle = (own[row, (n - 1) // 2] + own[row, np.minimum(n // 2, width - 1)]) / 2
    near = np.abs(own - middle[:, None]) <= width
    n, first = near.sum(1), near.argmax(1)
    some = n > 0
    own, n, begins, first, row = own[some], n[some], begins[some], first[some], row[: some.sum()]
    if not len(begins):
        return []
    lo_b, hi_b = own[row, first], own[row, first + n - 1] + 1
    j = n / (width + hi_b - lo_b - n)
    if not p.plain:
        _exact(p, begins, lo_b, hi_b, j, width)
        short = np.flatnonzero((j >= similarity) & (hi_b - lo_b < similarity * width))
        if len(short):
            lo_b[short], hi_b[short] = _widened(p, lo_b[short], hi_b[short], width)
            own_j = j[short]
            _exact(p, begins[short], lo_b[short], hi_b[short], own_j, width)
            j[short] = own_j
    ok = (j >= similarity) & (hi_b - lo_b >= similarity * width)
    begins, lo_b, hi_b, j = begins[ok], lo_b[ok], hi_b[ok], j[ok]
    if not len(begins):
        return []
    out: list[tuple] = []
    cut = (np.flatnonzero(np.diff(begins) > width) + 1).tolist()
    todo = list(zip([0, *cut], [*cut, len(begins)], strict=True))[::-1]
    while todo:  # as few spans as are verified as a whole
        x, y = todo.pop()
        lo, hi, low, high = int(begins[x]), int(begins[y - 1]) + width, int(lo_b[x:y].min()), int(hi_b[x:y].max())
        if y - x == 1:
            out.append((lo, hi, low, high, float(j[x])))
        elif high - low <= 2 * (hi - lo) and (both := _alike(p, lo, hi, low, high)) >= similarity:
            out.append((lo, hi, low, high, both))
        else:
            todo += [((x + y) // 2, y), (x, (x + y) // 2)]
    return out


def _match(p: Pair, width: int, similarity: float) -> list[tuple]:
    need = int(np.ceil(width * 2 * similarity / (1 + similarity) - 1e-9))
    total = np.concatenate([[0], np.cumsum(p.hit)])
    good = np.flatnonzero(total[width:] - total[:-width] >= need)
    if not len(good):
        return []

    def judged(lo: int, hi: int, places: np.ndarray) -> tuple:
        lo_b, hi_b = int(places.min()), int(places.max()) + 1
        if not p.plain and hi_b - lo_b < similarity * width:
            lo_b, hi_b = (int(x[0]) for x in _widened(p, np.array([lo_b]), np.array([hi_b]), width))
        return lo, hi, lo_b, hi_b, _alike(p, lo, hi, lo_b, hi_b) if hi_b - lo_b >= similarity * width else 0.0

    gap = np.flatnonzero(np.diff(good) > width)
    out = []
    for s, e in zip(good[np.concatenate([[0], gap + 1])].tolist(), (good[np.concatenate([gap, [len(good) - 1]])] + width).tolist(), strict=True):
        m = np.flatnonzero(p.hit[s:e]) + s
        shift = p.place[m] - m
        near = np.abs(shift - np.sort(shift)[len(shift) // 2]) <= width
        if near.sum() >= need and (found := judged(s, e, p.place[m[near]]))[4] >= similarity:
            out.append(found)
            continue
        cuts = np.flatnonzero(np.abs(np.diff(shift)) > width)
        if len(cuts) > len(m) // 4:  # a phrase that b repeats: follow the usual distance only
            m, cuts = m[near], cuts[:0]
        for part in np.split(m, cuts + 1):
            if not len(part):
                continue
            lo, hi = (s if len(cuts) == 0 else int(part[0])), (e if len(cuts) == 0 else int(part[-1]) + 1)
            if hi - lo < width:
                continue
            if (found := judged(lo, hi, p.place[part]))[4] >= similarity:
                out.append(found)
            else:  # looser than its stretches: all of those that reach it
                out += _stretches(p, good[(good >= lo) & (good + width <= hi)], width, similarity)
    return out


def matching(a: np.ndarray | Sequence, b: np.ndarray | Sequence, width: int, similarity: float) -> list[tuple]:
    """Verified passages of two sequences: (begin, end in a, begin, end in b, similarity).

    A run of a is a union of stretches of ``width`` of which at least 2 s / (1 + s) values are in b, as
    a Jaccard similarity of s needs.  It is placed in b by its values there, cut where it continues
    elsewhere in b, and each piece's Jaccard similarity decides; of a piece that fails, that of each stretch.
    Neither side is shorter than ``similarity`` of ``width``: where b repeats what a holds, b's side is widened.
    """
    a, b = (x if isinstance(x, Sequence) else Sequence(x) for x in (a, b))
    return _match(Pair(a, b), width, similarity) if min(len(a.h), len(b.h)) >= width else []


def both_ways(a: Sequence, b: Sequence, width: int, similarity: float) -> list[tuple]:
    """Spans of ``matching`` from a to b and, where a text repeats a value, from b to a: it places a passage once in its second text."""
    out = matching(a, b, width, similarity)
    if a.repeats or b.repeats:
        out += [(lo, hi, lo_b, hi_b, j) for lo_b, hi_b, lo, hi, j in matching(b, a, width, similarity)]
    return list(dict.fromkeys(out))


def equal_runs(a: Sequence, b: Sequence, width: int) -> list[tuple[int, int]]:
    """Runs (begin, end) of b, of ``width`` or more, that a holds as well, value for value."""
    p = Pair(a, b)
    edge = np.flatnonzero(np.concatenate([[True], ~p.hit[1:] | ~p.hit[:-1] | (p.place[1:] != p.place[:-1] + 1), [True]]))
    long = np.flatnonzero((np.diff(edge) >= width) & p.hit[edge[:-1]])
    return [(int(p.place[edge[k]]), int(p.place[edge[k]] + edge[k + 1] - edge[k])) for k in long.tolist()]
