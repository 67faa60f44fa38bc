"""Token ids in a binary store of directly addressable codes.

Each id is split into chunks of ``BITS`` bits, lowest first.  Level 0 holds the lowest chunk of
every id; a continuation bitmap marks ids that go on, and level 1 holds the next chunk of those
only, and so on.  A rank directory holds the number of marked ids before every 512-bit word
group, so ``Segment.token(i)`` follows one id through the levels without decoding any other.

A store is a Parquet table of segments: whole documents, in ascending id order (null first), each
segment one binary payload with a document directory.  Spark's committer makes a lost task's
files vanish, so a retry leaves no double segments.  Null texts count as empty and hold only the
end id; rows that repeat an id stay next to each other; an empty table gives an empty store.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import saved, table
from ._text import split

MAGIC = b"DAC1"
BITS = 8
#: A segment is closed once it holds so many ids; a document is never split.
SEGMENT_TOKENS = 1 << 19
END_ID = 2
RANK_BITS = 512
#: Words whose ids a worker remembers, by 64-bit hash; when full, those used most stay.
#: Stands between words that are encoded together; one that holds it is encoded alone.
SEPARATOR = "§"
TABLE_WORDS = 1 << 20


# ---------------------------------------------------------------- the codes

def encode(ids: np.ndarray, docs: np.ndarray, lengths: np.ndarray) -> bytes:
    """A segment: header, document directory, then levels of (count, chunks, bitmap, ranks)."""
    out = [MAGIC, struct.pack("<BQQ", BITS, len(docs), len(ids)), docs.astype("<i8").tobytes(), lengths.astype("<u4").tobytes()]
    rest = ids.astype(np.uint32)
    while True:
        more = rest >> np.uint32(BITS)
        on = more != 0
        bits = np.packbits(on, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (RANK_BITS // 8), np.uint8)])
        counts = np.bitwise_count(bits.view("<u8")).reshape(-1, RANK_BITS // 64).sum(1)
        ranks = np.concatenate([[0], np.cumsum(counts)]).astype("<u4")
        out += [struct.pack("<Q", len(rest)), (rest & np.uint32((1 << BITS) - 1)).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()]
        if not on.any():
            break
        rest = more[on]
    return b"".join(out)


class Segment:
    """Reads one payload; any id by position, or all of them."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        self.bits, n_docs, self.n = struct.unpack_from("<BQQ", payload, 4)
        at = 21
        self.docs = np.frombuffer(payload, "<i8", n_docs, at)
        self.lengths = np.frombuffer(payload, "<u4", n_docs, at := at + 8 * n_docs)
        at += 4 * n_docs
        self.levels = []
        while at < len(payload):
            (n,) = struct.unpack_from("<Q", payload, at)
            groups = -(-n // RANK_BITS)
            chunk = np.frombuffer(payload, np.uint8, n, at := at + 8)
            bitmap = np.frombuffer(payload, np.uint8, groups * RANK_BITS // 8, at := at + n)
            ranks = np.frombuffer(payload, "<u4", groups + 1, at := at + len(bitmap))
            at += 4 * (groups + 1)
            self.levels.append((chunk, bitmap, ranks))

    def token(self, i: int) -> int:
        """The id at position ``i``: one chunk, one bit and one rank a level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for chunk, bitmap, ranks in self.levels:
            value |= int(chunk[i]) << shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                return value
            g = i // RANK_BITS
            inside = np.unpackbits(bitmap[g * RANK_BITS // 8 : (i >> 3) + 1], bitorder="little")[: i - g * RANK_BITS]
            i, shift = int(ranks[g]) + int(inside.sum()), shift + self.bits
        return value

    def ids(self) -> np.ndarray:
        """All ids, as uint32."""
        value = None
        for depth in range(len(self.levels) - 1, -1, -1):
            chunk, bitmap, _ = self.levels[depth]
            own = chunk.astype(np.uint32)
            if value is not None:
                on = np.unpackbits(bitmap, count=len(chunk), bitorder="little").view(bool)
                own[on] |= value << np.uint32(self.bits)
            value = own
        return value if value is not None else np.empty(0, np.uint32)


# ---------------------------------------------------------------- tokenizing

_TOKENIZERS: dict[str, WordTokenizer] = {}


class WordTokenizer:
    """Whole texts to ids through a word cache.

    This vocabulary's tokens never cross white space and its normaliser works inside words, so a
    text's ids are its words' ids in order; the tests hold that against encoding whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.separator = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
        self._clear()

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        """This worker's tokenizer, whose words outlive a task."""
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = cls(path)
        return _TOKENIZERS[path]

    def _clear(self) -> None:
        self.flat = np.empty(0, np.uint32)
        self.begin = np.empty(0, np.int64)
        self.size = np.empty(0, np.int64)
        self.uses = np.empty(0, np.int64)
        self.keys = np.empty(0, np.uint64)
        self._index()

    def _index(self) -> None:
        """An open-addressing table from word hash to word number, a quarter full at most."""
        self.slot_key, self.slot_word = np.zeros(4 * TABLE_WORDS, np.uint64), np.zeros(4 * TABLE_WORDS, np.int32)
        self._place(self.keys, 0)

    def _probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each key's slot, or the empty slot where it would go, and whether it is there."""
        mask = np.uint64(len(self.slot_key) - 1)
        at = (keys & mask).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            held = self.slot_key[at[todo]]
            todo = todo[(held != keys[todo]) & (held != 0)]
            at[todo] = (at[todo] + 1) & int(mask)
        return at, self.slot_key[at] == keys

    def _place(self, keys: np.ndarray, number: int) -> None:
        """Add distinct new keys, numbered from ``number``."""
        todo = np.arange(len(keys))
        while len(todo):
            at, _ = self._probe(keys[todo])
            _, first = np.unique(at, return_index=True)  # one key for each empty slot, the others go on
            self.slot_key[at[first]] = keys[todo[first]]
            self.slot_word[at[first]] = number + todo[first]
            todo = np.delete(todo, first)

    def _encode_words(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and how many each has."""
        plain = [w for w in new if SEPARATOR not in w and "<|" not in w]
        odd = [w for w in new if SEPARATOR in w or "<|" in w]
        new[:] = plain + odd
        runs = [f" {SEPARATOR} ".join(plain[i : i + 256]) + f" {SEPARATOR}" for i in range(0, len(plain), 256)]
        flat = np.array(list(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False))), np.uint32)
        # a word that has no separator in it has none of the separator's ids in this order
        hit = np.ones(len(flat), bool)
        for j, x in enumerate(self.separator):
            hit &= np.roll(flat == x, -j) if len(flat) else hit
        ends = np.flatnonzero(hit)
        keep = np.ones(len(flat), bool)
        for j in range(len(self.separator)):
            keep[ends + j] = False
        size = np.diff(np.concatenate([[-len(self.separator)], ends])) - len(self.separator)
        if len(size) != len(plain):
            raise AssertionError("words and separators don't match")
        got = [e.ids for e in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)]
        return np.concatenate([flat[keep], np.array(list(chain.from_iterable(got)), np.uint32)]), np.concatenate([size, np.array([len(g) for g in got], np.int64)])

    def _learn(self, keys: np.ndarray, new: list[str]) -> None:
        order = {w: k for w, k in zip(new, keys.tolist(), strict=True)}
        flat, size = self._encode_words(new)
        keys = np.array([order[w] for w in new], np.uint64)
        self._place(keys, len(self.keys))
        self.keys = np.concatenate([self.keys, keys])
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
        self.flat = np.concatenate([self.flat, flat])
        self.size = np.concatenate([self.size, size])
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])

    def _forget(self) -> None:
        """Keep the words used most, half of the room at most."""
        stay = np.sort(np.argsort(-self.uses, kind="stable")[: TABLE_WORDS // 2])
        stay = stay[self.uses[stay] > 1]
        size = self.size[stay]
        stop = np.cumsum(size)
        flat = self.flat[np.repeat(self.begin[stay] - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]
        self.flat, self.begin, self.size, self.uses, self.keys = flat, stop - size, size, self.uses[stay] >> 1, self.keys[stay]
        self._index()

    @staticmethod
    def _folded(text: str) -> bytes:
        """The text with the same ids, changed so that more of its words are known ones."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.encode()  # beyond these characters lower-casing is left to the tokenizer
        return text.lower().encode()

    def _in_parts(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode_many``, for more distinct words than the table holds: half of the texts, or of a text's words, at once."""
        if len(texts) > 1:
            halves = [self.encode_many(t, end_id) for t in (texts[: len(texts) // 2], texts[len(texts) // 2 :])]
            return tuple(np.concatenate(c) for c in zip(*halves, strict=True))
        (text,) = texts
        blanks = [m.start() for m in re.finditer(r"[ \t-\r]+(?=[^ \t-\r])", text)]
        cut = blanks[len(blanks) // 2]
        (first, n), (second, m) = self.encode_many([text[:cut]], end_id), self.encode_many([text[cut:]], end_id)
        return np.concatenate([first[:-1], second]), n + m - 1

    def encode_many(self, texts: list[str], end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, each text's followed by ``end_id``, and each text's length."""
        keys, off, joined, start, end = split([self._folded(t) for t in texts], peel=True)
        keys |= np.uint64(keys == 0)
        if not len(keys):
            return np.full(len(texts), end_id, np.uint32), np.ones(len(texts), np.int64)
        counts = np.diff(off)
        at, known = self._probe(keys)
        if not known.all():
            if len(self.keys) + len(keys) > TABLE_WORDS:
                self._forget()
                at, known = self._probe(keys)
            missing = np.flatnonzero(~known)
            new, first = np.unique(keys[missing], return_index=True)
            if len(self.keys) + len(new) > len(self.slot_key) // 2:
                return self._in_parts(texts, end_id)
            where = missing[first]
            self._learn(new, [joined[a:b].decode() for a, b in zip(start[where].tolist(), end[where].tolist(), strict=True)])
            at, _ = self._probe(keys)
        word = self.slot_word[at]
        self.uses += np.bincount(word, minlength=len(self.uses))
        size = self.size[word]
        stop = np.cumsum(size)
        flat = self.flat[np.repeat(self.begin[word] - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]
        totals = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(counts)])]
        ids = np.full(len(flat) + len(texts), end_id, np.uint32)
        lengths = np.diff(totals) + 1
        keep = np.ones(len(ids), bool)
        keep[np.cumsum(lengths) - 1] = False
        ids[keep] = flat
        return ids, lengths


# ---------------------------------------------------------------- write and read

_STORE = "part int, seg int, n_docs long, n_tokens long, payload binary"
_READ = "doc_id long, part int, seg int, nth long, local_start long, n_tokens long, ids_crc32 long"


def write_store(docs: DataFrame, tokenizer_path: str, name: str = "token-store", id_col: str = "doc_id", text_col: str = "text", segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """Tokenize, order by id, write the store to the shared folder; returns the written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part, seg = WordTokenizer.of(tokenizer_path), TaskContext.get().partitionId(), 0
        held_ids, held_docs, held_len, total = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal held_ids, held_docs, held_len, total, seg
            docs_, lens = np.concatenate(held_docs), np.concatenate(held_len)
            row = [[part], [seg], [len(docs_)], [total], [encode(np.concatenate(held_ids), docs_, lens)]]
            held_ids, held_docs, held_len, total, seg = [], [], [], 0, seg + 1
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "seg", "n_docs", "n_tokens", "payload"])

        for batch in batches:
            keys = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            at = 0
            while at < len(keys):
                texts, size, begin = [], 0, at
                while at < len(keys) and size < 1 << 20:
                    texts.append(batch.column(1)[at].as_py() or "")
                    size, at = size + len(texts[-1]), at + 1
                ids, lengths = tokenizer.encode_many(texts)
                held_ids.append(ids)
                held_docs.append(keys[begin:at])
                held_len.append(lengths)
                total += len(ids)
                if total >= segment_tokens:
                    yield close()
        if held_docs:
            yield close()

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return saved(ordered.mapInArrow(run, _STORE), name)


#: Stands for a null id in the directory, as the first in order.
NO_ID = -(1 << 63)


def read_store(store: DataFrame) -> DataFrame:
    """From the payloads alone: doc_id, start (ids before it), n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seg, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                s = Segment(payload)
                ids, n = s.ids().astype("<u4"), s.lengths.astype(np.int64)
                stop = np.cumsum(n)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(stop.tolist(), n.tolist(), strict=True)]
                key = pa.array(s.docs, pa.int64(), mask=s.docs == NO_ID)
                cols = [key, pa.array(np.full(len(n), part, np.int32)), pa.array(np.full(len(n), seg, np.int32)), pa.array(np.arange(len(n))), pa.array(stop - n), pa.array(n), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "part", "seg", "nth", "local_start", "n_tokens", "ids_crc32"])

    read = store.select("part", "seg", "payload").mapInArrow(run, _READ)
    # Places of the segments: totals of the parts first, so no window holds more than the parts, or one part's segments.
    sizes = store.select("part", "seg", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))
    parts = parts.select("part", (F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).alias("before_part"))
    segs = sizes.select("part", "seg", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seg")) - F.col("n_tokens")).alias("before_seg"))
    places = segs.join(parts, "part").select("part", "seg", (F.col("before_part") + F.col("before_seg")).alias("before"))
    return read.join(places, ["part", "seg"]).select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_store(write_store(table(spark, sf_dir, "documents"), tokenizer_path()))
