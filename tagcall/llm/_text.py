"""Vectorised word and shingle hashing of many texts at once (numpy only)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U = np.uint64
#: Texts are handled in chunks of about this many characters, so memory stays bounded by the longest text.
CHUNK_CHARS = 1 << 19
_PRIME, _STEP = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int, base: np.uint64 = _PRIME) -> np.ndarray:
    out = np.full(max(n, 1), base)
    out[0] = U(1)
    return np.multiply.accumulate(out)


_POWERS = powers(4096)


def chunks(rows: Iterable[tuple], text_at: int = 1, limit: int = CHUNK_CHARS) -> Iterator[list[tuple]]:
    """Rows in lists of about ``limit`` characters of text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[text_at] or "") + 16
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def split(raw: list[bytes], peel: bool = False) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """Words of UTF-8 texts: hashes, offsets, and the joined bytes with each word's first and end byte.

    A word is a run of characters outside ``[\\x20\\x09-\\x0D]``; text i has the words off[i] to off[i + 1].
    ``peel``: a full stop or comma that ends a run, after a letter a to z, is a word of its own.
    """
    begins = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=begins[1:])
    text = b" ".join(raw) + b" "
    b = np.frombuffer(text, np.uint8)
    word = ~_BLANK[b]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    start, end = edge[0::2], edge[1::2]
    if peel and len(start):
        last = b[end - 1]
        cut = end[((last == 0x2E) | (last == 0x2C)) & (b[end - 2] - np.uint8(0x61) < 26) & (end - start > 1)] - 1
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    off = np.searchsorted(start, begins)
    if not len(start):
        return np.empty(0, U), off, text, start, end
    sizes = end - start
    global _POWERS
    if (longest := int(sizes.max())) > len(_POWERS):
        _POWERS = powers(longest)
    at = np.flatnonzero(word)
    firsts = np.cumsum(sizes) - sizes
    place = np.arange(len(at)) - np.repeat(firsts, sizes)
    return mix(np.add.reduceat((b[at].astype(U) + U(1)) * _POWERS[place], firsts)), off, text, start, end


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and offsets; a null text has none."""
    return split([(t or "").lower().encode("utf-8", "surrogatepass") for t in texts])[:2]


def shingles(w: np.ndarray, off: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words in order, and offsets; a text of 1 to k - 1 words is one shingle."""
    n = np.diff(off)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    out_off = np.concatenate([[0], np.cumsum(count)])
    if not len(w):
        return np.empty(0, U), out_off
    doc = np.repeat(np.arange(len(n)), count)
    at = off[:-1][doc] + np.arange(out_off[-1]) - out_off[:-1][doc]
    end = off[1:][doc]
    padded = np.concatenate([w, np.zeros(k, U)])
    h = np.zeros(len(at), U)
    for j in range(k):
        h = h * _STEP + np.where(at + j < end, padded[at + j], U(0x5555))
    return mix(h), out_off


def fingerprints(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's sequence of hashes; 0 and 0 for an empty one."""
    n = np.diff(off)
    out = np.zeros((2, len(n)), U)
    full = np.flatnonzero(n)
    if len(full):
        longest = int(n.max())
        place = np.arange(len(h)) - np.repeat(off[:-1], n)
        for r, prime in enumerate((_PRIME, _STEP)):
            p = np.full(longest, prime)
            p[0] = U(1)
            p = np.multiply.accumulate(p)
            out[r, full] = mix(np.add.reduceat(mix(h + U(r + 1)) * p[place], off[:-1][full]) + n[full].astype(U))
    return out[0], out[1]
