"""BAM indexes (.bai): which ranges of a file hold the reads of a contig, or of a part of it.

Offsets are virtual: a block's place in the file times 65,536, plus a place in its inflated data.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from . import files

#: Fixed values of the format: letters it begins with, the bin that holds counts, the width of a window.
MAGIC, COUNTS_BIN, WINDOW_BITS = b"BAI\x01", 37450, 14
#: For each level, how far positions are shifted and its first bin.
LEVELS = ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681))


@dataclass
class Contig:
    bins: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    windows: list[int] = field(default_factory=list)
    mapped: int = 0
    unmapped: int = 0


def bin_of(begin: int, end: int) -> int:
    """The smallest bin that holds a half-open span."""
    return next((first + (begin >> shift) for shift, first in reversed(LEVELS) if begin >> shift == max(begin, end - 1) >> shift), 0)


def overlapping(begin: int, end: int | None) -> list[range]:
    """Bins that may hold reads of a span, level by level; an open end reaches to the last bin."""
    last = (1 << 29) - 1 if end is None else min(end, 1 << 29) - 1
    return [range(1), *(range(first + (begin >> shift), first + (last >> shift) + 1) for shift, first in LEVELS)]


def read_index(path: str) -> list[Contig] | None:
    """The index of a BAM file, beside it as ``x.bam.bai`` or ``x.bai``; None where there is none."""
    found = next((p for p in (f"{path}.bai", f"{path.removesuffix('.bam')}.bai") if files.size(p) is not None), None)
    if found is None:
        return None
    with files.opened(found) as f:
        data = f.read()
    try:
        if data[:4] != MAGIC:
            raise ValueError(f"{found} is not a BAM index")
        return _parse(data)
    except struct.error as e:
        raise ValueError(f"{found} is cut off") from e


def _parse(data: bytes) -> list[Contig]:
    at = 4

    def take(form: str) -> tuple:
        nonlocal at
        values = struct.unpack_from("<" + form, data, at)
        at += struct.calcsize("<" + form)
        return values

    out = []
    for _ in range(take("i")[0]):
        c = Contig()
        for _ in range(take("i")[0]):
            number, n = take("Ii")
            pairs = take(f"{2 * n}Q")
            chunks = list(zip(pairs[0::2], pairs[1::2], strict=True))
            if number != COUNTS_BIN:
                c.bins[number] = chunks
            elif n == 2:
                c.mapped, c.unmapped = chunks[1]
        c.windows = list(take(f"{take('i')[0]}Q"))
        out.append(c)
    return out


def ranges(c: Contig, begin: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    """Virtual ranges of the reads that start in a span, in file order, joined where a block ends one and begins the next."""
    wanted = overlapping(begin, end)
    # no read of the span lies before the first one that reaches its first window
    least = next((w for w in reversed(c.windows[: (begin >> WINDOW_BITS) + 1]) if w), 0) if begin else 0
    found = sorted((max(a, least), b) for number, chunks in c.bins.items() if any(number in r for r in wanted) for a, b in chunks if b > least)
    out: list[tuple[int, int]] = []
    for a, b in found:
        if out and a >> 16 <= out[-1][1] >> 16:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def cut(c: Contig, spans: list[tuple[int, int]], split: int) -> list[tuple[int, int]]:
    """The same ranges in pieces of about ``split`` bytes of the file; windows begin at records, so pieces do."""
    out = []
    places = sorted({w for w in c.windows if w})
    for a, b in spans:
        for w in places:
            if a < w < b and (w >> 16) - (a >> 16) >= split:
                out.append((a, w))
                a = w
        out.append((a, b))
    return out


class Builder:
    """Collects records in file order and writes the index."""

    def __init__(self, contigs: int):
        self.contigs = [Contig() for _ in range(contigs)]
        self.spans: dict[int, tuple[int, int]] = {}
        self.homeless = 0

    def add(self, ref: int, begin: int, end: int, mapped: bool, at: int, after: int) -> None:
        if ref < 0:
            self.homeless += 1
            return
        c = self.contigs[ref]
        chunks = c.bins.setdefault(bin_of(begin, end), [])
        if chunks and chunks[-1][1] == at:
            chunks[-1] = chunks[-1][0], after
        else:
            chunks.append((at, after))
        c.windows += [0] * (((max(begin + 1, end) - 1) >> WINDOW_BITS) + 1 - len(c.windows))
        for w in range(begin >> WINDOW_BITS, ((max(begin + 1, end) - 1) >> WINDOW_BITS) + 1):
            c.windows[w] = c.windows[w] or at
        self.spans[ref] = self.spans.get(ref, (at, at))[0], after
        c.mapped, c.unmapped = c.mapped + mapped, c.unmapped + (not mapped)

    def bytes(self) -> bytes:
        out = [MAGIC, struct.pack("<i", len(self.contigs))]
        for ref, c in enumerate(self.contigs):
            counts = [(COUNTS_BIN, [self.spans[ref], (c.mapped, c.unmapped)])] if ref in self.spans else []
            out.append(struct.pack("<i", len(c.bins) + len(counts)))
            for number, chunks in [*sorted(c.bins.items()), *counts]:
                out.append(struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *x) for x in chunks))
            out.append(struct.pack(f"<i{len(c.windows)}Q", len(c.windows), *c.windows))
        return b"".join(out) + struct.pack("<Q", self.homeless)
