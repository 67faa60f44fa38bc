"""BAM as a Spark data source, in plain Python: BGZF blocks and records are decoded with ``zlib``.

``load(spark, path)`` reads a file, or a folder of them.  Executors open the path themselves, by any scheme of ``files``.

A filter on region, also with bounds of pos, reads only the blocks that the file's index (.bai)
names for it.  Without such a filter, or without an index, a file is cut into ranges of compressed
bytes; each range's first record is found by the chain of record sizes from a block's start.
Records that a filter on region or mapq rejects are not decoded.  A file that is cut off, or a block
whose checksum is wrong, is an error.
"""

from __future__ import annotations

import struct
import zlib
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from . import bai, files

SCHEMA = "qname string, region string, pos long, mapq long, flag long, cigar string, seq string, qual string"
#: Fixed values of the format: letters of 4-bit bases and of operations.
BASES, OPERATIONS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
#: Fixed value of the format: the empty block that ends a file.
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
SPLIT_BYTES = 64 << 20


class Range(InputPartition):
    """Records that begin in a range of a file: of compressed bytes, or ``exact`` virtual offsets of an index."""

    def __init__(self, path: str, begin: int, end: int, exact: bool = False):
        self.path, self.begin, self.end, self.exact = path, begin, end, exact


def block_size(head: bytes) -> int:
    """Whole size of the BGZF block whose first 18 bytes are given; 0 if they begin none."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04" or head[12:16] != b"BC\x02\x00":
        return 0
    return struct.unpack_from("<H", head, 16)[0] + 1


def inflate(block: bytes) -> bytes:
    try:
        data = zlib.decompress(block[18:-8], -15)
    except zlib.error as e:
        raise ValueError(f"damaged BGZF block: {e}") from e
    if struct.unpack("<II", block[-8:]) != (zlib.crc32(data), len(data)):
        raise ValueError("damaged BGZF block: its checksum or size is wrong")
    return data


def paths(path: str) -> list[str]:
    return files.listed(path, ".bam")


def header_contigs(path: str) -> list[str]:
    """Contig names in header order, of the first file where there are many."""
    return [n for n, _ in read_header(paths(path)[0])[0]]


def indexed_catalog(spark: SparkSession, path: str, min_reads: int = 0) -> DataFrame | None:
    """(contig_idx, region, length, num_reads) from header and index, without reading a record; None without an index.

    ``num_reads`` are the placed and mapped ones, of all files of a folder.
    """
    total: dict[str, list[int]] = {}
    for p in paths(path):
        index = bai.read_index(p)
        if index is None:
            return None
        for (name, length), c in zip(read_header(p)[0], index, strict=True):
            own = total.setdefault(name, [length, 0])
            own[1] += c.mapped
    rows = [(i, n, k, m) for i, (n, (k, m)) in enumerate(total.items()) if m >= min_reads]
    return spark.createDataFrame(rows, "contig_idx int, region string, length long, num_reads long")


def read_header(path: str) -> tuple[list[tuple[str, int]], int, int]:
    """Names and lengths of contigs, and where records begin: compressed offset of the block, offset inside it."""
    with files.opened(path) as f:
        r = Inflated(f, 0, path)
        r.need(8)
        if r.data[:4] != b"BAM\x01":
            raise ValueError(f"{path} is not a BAM file")
        r.pos = 8 + struct.unpack_from("<i", r.data, 4)[0]
        contigs = []
        for _ in range(r.int()):
            n = r.int()
            r.need(n + 4)
            name = r.data[r.pos : r.pos + n - 1].decode()
            r.pos += n
            contigs.append((name, r.int()))
        at = r.virtual()
    return contigs, at >> 16, at & 0xFFFF


class Inflated:
    """Blocks of a file from an offset on, inflated as they are asked for."""

    def __init__(self, f, at: int, path: str):
        self.f, self.at, self.path = f, at, path
        self.data, self.pos = b"", 0
        self.blocks: deque[tuple[int, int, int]] = deque()  # begin and end in data, compressed offset

    def more(self) -> bool:
        """One more block; False at the end of the file."""
        self.f.seek(self.at)
        block = self.f.read(1 << 16)
        if not block:
            return False
        n = block_size(block)
        if not 0 < n <= len(block):
            raise ValueError(f"{self.path}: no whole BGZF block at {self.at}" if self.at else f"{self.path} is not a BAM file")
        if self.pos > 1 << 20:
            self.data = self.data[self.pos :]
            self.blocks = deque((a - self.pos, b - self.pos, c) for a, b, c in self.blocks if b > self.pos)
            self.pos = 0
        begin = len(self.data)
        self.data += inflate(block[:n])
        self.blocks.append((begin, len(self.data), self.at))
        self.at += n
        return True

    def need(self, n: int) -> None:
        """At least ``n`` bytes from the current place on."""
        while self.pos + n > len(self.data):
            if not self.more():
                raise ValueError(f"{self.path} ends inside a record")

    def int(self) -> int:
        self.need(4)
        self.pos += 4
        return struct.unpack_from("<i", self.data, self.pos - 4)[0]

    def virtual(self) -> int:
        """The virtual offset of the current place; that of the next block at the end of one."""
        while self.blocks and self.blocks[0][1] <= self.pos:
            self.blocks.popleft()
        if not self.blocks:
            return self.at << 16
        begin, _, at = self.blocks[0]
        return at << 16 | self.pos - begin


def decode(record: bytes, names: list[str]) -> tuple:
    """One record (without its size) as a row."""
    ref, pos, name_len, mapq, _, n_ops, flag, n = struct.unpack_from("<iiBBHHHi", record, 0)
    at = 32
    qname = record[at : at + name_len - 1].decode()
    at += name_len
    ops = struct.unpack_from(f"<{n_ops}I", record, at)
    at += 4 * n_ops
    packed = record[at : at + (n + 1) // 2]
    at += (n + 1) // 2
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:n]
    raw = record[at : at + n]
    qual = "*" if not n or raw[0] == 255 else bytes(q + 33 for q in raw).decode()
    cigar = "".join(f"{o >> 4}{OPERATIONS[o & 15]}" for o in ops) or "*"
    return qname, names[ref] if ref >= 0 else None, pos, mapq, flag, cigar, seq or "*", qual


def plausible(data: bytes, at: int, n_refs: int) -> bool:
    """Can a record begin here?"""
    if at + 36 > len(data):
        return False
    size, ref, pos, name_len, _, _, n_ops, _, n, mate, mate_pos = struct.unpack_from("<iiiBBHHHiii", data, at)
    fits = 32 + name_len + 4 * n_ops + (n + 1) // 2 + n <= size < 1 << 24
    return fits and -1 <= ref < n_refs and -1 <= mate < n_refs and pos >= -1 and mate_pos >= -1 and name_len > 0 and n >= 0


class BamReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split
        self.regions: set[str] | None = None
        self.min_mapq, self.begin, self.end = 0, 0, None  # positions from begin to before end
        self.headers: dict[str, tuple] = {}  # of each file, read once while partitions are planned

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("region",) and isinstance(f, EqualTo | In):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.regions = own if self.regions is None else self.regions & own
            elif column == ("mapq",) and isinstance(f, GreaterThanOrEqual):
                self.min_mapq = max(self.min_mapq, f.value)
            elif column == ("pos",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.begin = max(self.begin, f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    end = f.value + (not isinstance(f, LessThan))
                    self.end = end if self.end is None else min(self.end, end)
            yield f  # Spark tests it again

    def partitions(self) -> list[Range]:
        out = []
        for path in paths(self.path):
            size = files.size(path)
            if size is None:
                raise ValueError(f"there is no file {path}")
            with files.opened(path) as f:
                f.seek(max(0, size - len(END)))
                if f.read() != END:
                    raise ValueError(f"{path} is cut off: the block that ends a BAM file is missing")
            self.headers[path] = read_header(path)
            index = bai.read_index(path) if self.regions is not None else None
            if index is None:
                out += [Range(path, b, min(b + self.split, size)) for b in range(0, size, self.split)]
                continue
            for (name, _), c in zip(self.headers[path][0], index, strict=True):
                if name in self.regions:
                    out += [Range(path, a, b, True) for a, b in bai.cut(c, bai.ranges(c, self.begin, self.end), self.split)]
        return out

    def read(self, part: Range) -> Iterator[tuple]:
        if not isinstance(part, Range):  # Spark's stand-in where no range is left
            return
        contigs, first_block, first_inside = self.headers.get(part.path) or read_header(part.path)
        names = [n for n, _ in contigs]
        wanted = None if self.regions is None else {i for i, n in enumerate(names) if n in self.regions}
        with files.opened(part.path) as f:
            stop = part.end if part.exact else part.end << 16
            if part.exact:
                r, inside = Inflated(f, part.begin >> 16, part.path), part.begin & 0xFFFF
            elif part.begin <= first_block:
                r, inside = Inflated(f, first_block, part.path), first_inside
            else:
                at = self._next_block(f, part.begin, f.size())
                if at >= part.end:
                    return
                r, inside = Inflated(f, at, part.path), None
            if not r.more():
                return
            if inside is None:  # the first record that begins in this block or later
                while len(r.data) < 1 << 18 and r.more():
                    pass
                inside = next((i for i in range(len(r.data)) if self._chain(r.data, i, len(names))), len(r.data))
            r.pos = inside
            while r.virtual() < stop:
                if r.pos == len(r.data) and not r.more():
                    return
                if r.virtual() >= stop:
                    return
                n = r.int()
                r.need(n)
                record = r.data[r.pos : r.pos + n]
                r.pos += n
                ref, pos = struct.unpack_from("<ii", record)
                if (wanted is None or ref in wanted) and record[9] >= self.min_mapq and (wanted is None or pos >= self.begin):
                    yield decode(record, names)

    @staticmethod
    def _next_block(f, at: int, size: int) -> int:
        while at < size:
            f.seek(at)
            window = f.read((1 << 16) + 18)
            i = window.find(b"\x1f\x8b\x08\x04")
            while i >= 0:
                if n := block_size(window[i : i + 18]):
                    f.seek(at + i + n)
                    if at + i + n >= size or block_size(f.read(18)):
                        return at + i
                i = window.find(b"\x1f\x8b\x08\x04", i + 1)
            at += 1 << 16
        return size

    @staticmethod
    def _chain(data: bytes, at: int, n_refs: int) -> bool:
        for _ in range(8):
            if at == len(data) or at + 36 > len(data):
                return True
            if not plausible(data, at, n_refs):
                return False
            at += 4 + struct.unpack_from("<i", data, at)[0]
            if at > len(data):
                return True
        return True


class BamDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options["path"], int(self.options.get("split", SPLIT_BYTES)))


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(BamDataSource)


def load(spark: SparkSession, path: str, split: int = SPLIT_BYTES) -> DataFrame:
    """The reads of a file or folder.

    The filter that all reads pass has Spark plan every use anew: of a table of a Python source, a
    use without filters would else take over the filters that an earlier use pushed.
    """
    register(spark)
    return spark.read.format("bam").option("split", split).load(path).where("mapq >= 0")


def write_bam(rows: list[tuple], contigs: list[tuple[str, int]], path: str, block: int = 60_000, index: bool = False) -> None:
    """A small BAM file from rows of the schema and (name, length) of contigs, with its index if wanted; for tests and samples."""
    numbers = {n: i for i, (n, _) in enumerate(contigs)}
    text = "".join(f"@SQ\tSN:{n}\tLN:{k}\n" for n, k in contigs).encode()
    out = [b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(contigs))]
    out += [struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k) for n, k in contigs]
    places, at = [], sum(map(len, out))  # (contig, begin, end, mapped, offset, offset after) of each record
    for qname, region, pos, mapq, flag, cigar, seq, qual in rows:
        ops, number = [], ""
        for ch in cigar if cigar != "*" else "":
            if ch.isdigit():
                number += ch
            else:
                ops.append(int(number) << 4 | OPERATIONS.index(ch))
                number = ""
        codes = [BASES.index(b) for b in seq] + [0] * (len(seq) % 2)
        end = pos + sum(o >> 4 for o in ops if OPERATIONS[o & 15] in "MDN=X")
        ref, number = numbers.get(region, -1), bai.bin_of(max(pos, 0), max(end, pos + 1, 1))
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(qname) + 1, mapq, number, len(ops), flag, len(seq), -1, -1, 0) + qname.encode() + b"\0"
        body += struct.pack(f"<{len(ops)}I", *ops) + bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2))
        body += b"\xff" * len(seq) if qual == "*" else bytes(ord(q) - 33 for q in qual)
        out.append(struct.pack("<i", len(body)) + body)
        places.append((ref, max(pos, 0), end, not flag & 4, at, at + len(out[-1])))
        at += len(out[-1])
    data, starts = b"".join(out), []
    with open(path, "wb") as f:
        for i in [*range(0, len(data), block), None]:
            starts.append(f.tell())
            chunk = b"" if i is None else data[i : i + block]
            packer = zlib.compressobj(6, zlib.DEFLATED, -15)
            packed = packer.compress(chunk) + packer.flush()
            f.write(b"\x1f\x8b\x08\x04" + b"\0" * 5 + b"\xff\x06\0BC\x02\0" + struct.pack("<H", len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(chunk), len(chunk)))
    if index:
        built = bai.Builder(len(contigs))
        virtual = lambda o: starts[o // block] << 16 | o % block
        for ref, begin, end, mapped, a, b in places:
            built.add(ref, begin, end, mapped, virtual(a), virtual(b))
        with open(f"{path}.bai", "wb") as f:
            f.write(built.bytes())
