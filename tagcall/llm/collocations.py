"""Phrase collocations: count-min sketches find what may be frequent, an exact count follows, then scores.

First pass: every task adds its words and pairs of words to a count-min sketch of ``DEPTH`` rows; the
sketches are merged in Spark by blocks of cells.  A cell is never less than the count of any n-gram
in it, so an n-gram one of whose cells stays below the least count is not frequent, and nothing
frequent is lost.  Longer n-grams go to a second sketch only where all their pairs may be frequent.
Last pass: n-grams whose cells all reach the least count, as must those of the n-grams inside them,
are counted exactly, by their words.  The width grows with the text, up to ``MOST_BITS``; beyond
that more n-grams are counted than need be, and results stay the same.

Texts are lower-cased in A-Z, cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and into words
``[^\\x20\\x09]+``.  Everything is for each language: n is all its words, a, l and r are occurrences
inside pieces, overlaps included.  A candidate has 2 words or more and a >= ``least``; of its cuts
the one with the lowest floor(1000 a n / (l r)) counts, the first of equals.  A candidate inside a
longer one that occurs at least ``part`` percent as often is dropped: occurrences never grow with
length, so looking at those one word longer is enough.

Null or empty text: no words.  Null language: ``und``.  Rows that repeat count each.  A language
without candidates, or an empty table, gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import saved, small, table
from ._text import U, chunks, mix, powers

LONGEST, LEAST, PART, TOP = 5, 100, 100, 2000
#: Rows of the sketch (the two halves of one hash), and its width: a cell for so many bytes of text, in powers of two.
DEPTH, CELL_BYTES, LEAST_BITS, MOST_BITS = 2, 32, 16, 27
#: Cells of a block, by which sketches are merged.
BLOCK = 1 << 14
#: Characters of a chunk; distinct n-grams that a task holds before it hands them on.
CHUNK, HELD = 1 << 21, 500_000
_STEP = U(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False


class Tokens:
    """Words of a chunk of rows (lang, text): hashes, pieces and languages, and their bytes."""

    def __init__(self, rows: list[tuple]):
        raw = [(t or "").encode("utf-8", "surrogatepass") for _, t in rows]
        self.langs = sorted({lang for lang, _ in rows})
        begins = np.cumsum([0] + [len(r) + 1 for r in raw])
        b = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]  # rows end in a break
        word = _WORD[b]
        edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
        self.start, self.end, self.bytes = edge[0::2], edge[1::2], b
        self.piece = np.cumsum(_BREAK[b], dtype=np.int32)[self.start]
        place = {lang: i for i, lang in enumerate(self.langs)}
        row = np.searchsorted(begins, self.start, "right") - 1
        self.lang = np.array([place[lang] for lang, _ in rows], np.int64)[row]
        self.sizes = self.end - self.start
        self.at = np.flatnonzero(word)
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self.within = np.arange(len(self.at)) - np.repeat(self.firsts, self.sizes)
        p = powers(int(self.sizes.max())) if len(self.start) else None
        self.hash = mix(np.add.reduceat((b[self.at].astype(U) + U(1)) * p[self.within], self.firsts)) if len(self.start) else np.empty(0, U)

    def __len__(self) -> int:
        return len(self.start)

    def language_hashes(self) -> np.ndarray:
        return np.array([int.from_bytes(lang.encode("utf-8", "surrogatepass")[:8].ljust(8, b"\0"), "little") + len(lang) for lang in self.langs], U)[self.lang]

    def ids(self) -> np.ndarray:
        """A number for each distinct word; equal hashes are held to equal bytes."""
        _, first, inverse = np.unique(self.hash, return_index=True, return_inverse=True)
        like = first[inverse]
        if (self.sizes == self.sizes[like]).all() and (self.bytes[self.at] == self.bytes[np.repeat(self.start[like], self.sizes) + self.within]).all():
            return inverse
        text, seen = self.bytes.tobytes(), {}
        return np.array([seen.setdefault(text[s:e], len(seen)) for s, e in zip(self.start, self.end, strict=True)], np.int64)


#: For each length of n-grams, one row of bits for each row of a sketch: which cells may hold frequent ones.
Sieve = dict[int, list[np.ndarray]]


def ngrams(t: Tokens, longest: int, sieve: Sieve, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, places, hashes) of the n-grams of each length that lie inside a piece and pass the sieve, as all n-grams inside them do."""
    at, h, before = np.arange(len(t)), mix(t.hash + mix(t.language_hashes())), None
    for k in range(1, longest + 1):
        if k > 1:
            keep = at + k - 1 < len(t)
            at, h = at[keep], h[keep]
            keep = (t.piece[at] == t.piece[at + k - 1]) & before[at + 1]
            at, h = at[keep], h[keep]
            h = mix(h * _STEP + t.hash[at + k - 1])
        if k in sieve:
            keep = np.ones(len(h), bool)
            for row, cell in zip(sieve[k], cells(h, bits), strict=True):
                keep &= (row[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
            at, h = at[keep], h[keep]
        before = np.zeros(len(t) + 1, bool)
        before[at] = True
        yield k, at, h


def cells(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each hash in each row of the sketch."""
    return [(h >> U(64 - bits)).astype(np.int64), (h & U((1 << bits) - 1)).astype(np.int64)]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def packed(block: np.ndarray) -> bytes:
    """Gaps between the cells that are not 0, low bytes before high ones, and their counts, compressed."""
    at = np.flatnonzero(block)
    return zlib.compress(np.diff(at, prepend=0).astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes() + block[at].tobytes())


def unpacked(data: bytes, kind: type) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(zlib.decompress(data), np.uint8)
    n = len(b) // (2 + np.dtype(kind).itemsize)
    return np.cumsum(b[:n] + (b[n : 2 * n].astype(np.int64) << 8)), b[2 * n :].view(kind)


def sketch(texts: DataFrame, lengths: range, least: int, sieve: Sieve, bits: int) -> list[np.ndarray]:
    """The sieve that a merged sketch of n-grams of some lengths gives; DEPTH << MOST_BITS - 3 bytes at most."""
    kind = next(k for k in (np.uint8, np.uint16, np.uint32) if least <= np.iinfo(k).max)
    shared = texts.sparkSession.sparkContext.broadcast(sieve)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((DEPTH, 1 << bits), kind)  # counts up to ``least``
        for part in chunks(_rows(batches), limit=CHUNK):
            found = zip(*(cells(h, bits) for k, _, h in ngrams(Tokens(part), lengths[-1], shared.value, bits) if k in lengths), strict=True)
            for row, own in zip(held, found, strict=True):
                cell, n = np.unique(np.concatenate(own).astype(np.uint32), return_counts=True)
                row[cell] = np.minimum(row[cell] + n, least)
        for r in range(DEPTH):
            for b, block in enumerate(held[r].reshape(-1, BLOCK)):
                if block.any():
                    yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([b], pa.int32()), pa.array([packed(block)])], ["row", "block", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (row, block), own in groupby(_rows(batches), key=itemgetter(0, 1)):
            total = np.zeros(BLOCK, np.int64)
            for _, _, n in own:
                at, n = unpacked(n, kind)
                total[at] += n
            if (total >= least).any():
                yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([block], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()])], ["row", "block", "bits"])

    parts = texts.mapInArrow(count, "row int, block int, n binary")
    merged = parts.repartition("row", "block").sortWithinPartitions("row", "block").mapInArrow(merge, "row int, block int, bits binary")
    out = [np.zeros(1 << bits - 3, np.uint8) for _ in range(DEPTH)]
    for row, block, own in merged.collect():
        out[row][block * BLOCK // 8 : (block + 1) * BLOCK // 8] = np.frombuffer(own, np.uint8)
    return out


def exact_counts(texts: DataFrame, longest: int, least: int, sieve: Sieve, bits: int) -> DataFrame:
    """(lang, phrase, k, n) of the n-grams with n >= least; k = 0 holds all words of a language.

    A task hands its counts on in lists, one for each part of the phrases by their checksum, and each
    part is added up by one task, which holds the part's phrases; there are more parts the more text there is.
    """
    shared = texts.sparkSession.sparkContext.broadcast(sieve)
    n_parts = 1 << max(bits - 16, 4)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, int] = {}

        def out() -> pa.RecordBatch:
            parts: dict[int, tuple[list, list, list, list]] = {}
            for (lang, phrase, k), n in sorted(held.items()):  # neighbours are alike, so lists compress well
                own = parts.setdefault(zlib.crc32(phrase) % n_parts, ([], [], [], []))
                for column, v in zip(own, (lang, phrase.decode("utf-8", "surrogatepass"), k, n), strict=True):
                    column.append(v)
            kinds = pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *(pa.array(list(c), kind) for c, kind in zip(zip(*parts.values(), strict=True), kinds, strict=True))], ["part", "lang", "phrase", "k", "n"])

        for part in chunks(_rows(batches), limit=CHUNK):
            t = Tokens(part)
            for i, n in enumerate(np.bincount(t.lang, minlength=len(t.langs)).tolist()):
                held[t.langs[i], b"", 0] = held.get((t.langs[i], b"", 0), 0) + n
            words, text = t.ids(), t.bytes.tobytes()
            whole = np.zeros(len(t), np.int64)
            for k, at, _ in ngrams(t, longest, shared.value, bits):
                # the number of an n-gram: that of its words but the last, and the last; exact, as both fit 31 bits
                own, first, inverse, n = np.unique((t.lang if k == 1 else whole)[at] << 32 | words[at + k - 1], return_index=True, return_inverse=True, return_counts=True)
                whole[at] = inverse
                for i, c in zip(at[first].tolist(), n.tolist(), strict=True):
                    key = t.langs[t.lang[i]], b" ".join([text[t.start[j] : t.end[j]] for j in range(i, i + k)]), k
                    held[key] = held.get(key, 0) + c
            if len(held) > HELD:
                yield out()
                held = {}
        if held:
            yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in groupby(_rows(batches), key=itemgetter(0)):
            total: dict[tuple, int] = {}
            for _, *columns in own:
                for *key, n in zip(*columns, strict=True):
                    key = tuple(key)
                    total[key] = total.get(key, 0) + n
            rows = [(*key, n) for key, n in total.items() if n >= least or key[2] == 0]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], ["lang", "phrase", "k", "n"])

    parts = texts.mapInArrow(count, "part int, lang array<string>, phrase array<string>, k array<int>, n array<long>")
    return parts.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "lang string, phrase string, k int, n long")


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, k, n): all n-grams with n >= least, and for each language all its words as k = 0."""
    texts = docs.select(F.coalesce(docs[lang_col], F.lit("und")).alias("lang"), docs[text_col].alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(max((size // CELL_BYTES).bit_length(), LEAST_BITS), MOST_BITS)
    short = sketch(texts, range(1, 3), least, {}, bits)
    sieve = {1: short, 2: short}
    if longest > 2:
        sieve |= dict.fromkeys(range(3, longest + 1), sketch(texts, range(3, longest + 1), least, sieve, bits))
    return saved(exact_counts(texts, longest, least, sieve, bits), "frequent-ngrams")


def _some(words: Column, begin: int | Column, n: Column) -> Column:
    return F.array_join(F.slice(words, begin, n), " ")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, part: int = PART, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score), the best ``top`` phrases of each language."""
    counts = frequent(docs, least, longest, text_col, lang_col)
    whole = counts.where("k = 0").select("lang", F.col("n").alias("total"))
    candidates = counts.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))

    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "k", "a", "cut", _some(F.col("w"), 1, F.col("cut")).alias("left"), _some(F.col("w"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    parts = small(counts.where(F.col("k").between(1, longest - 1)), 96)
    for name, column in (("left", "l"), ("right", "r")):
        cuts = cuts.join(parts.select("lang", F.col("phrase").alias(name), F.col("n").alias(column)), ["lang", name])
    cuts = cuts.join(F.broadcast(whole), "lang")  # a row a language
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("total"), wide("l") * wide("r"))
    best = cuts.groupBy("lang", "phrase", "k", "a", "total").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("s"))

    inside = candidates.where("k > 2").select("lang", "a", F.explode(F.array(_some(F.col("w"), 1, F.col("k") - 1), _some(F.col("w"), 2, F.col("k") - 1))).alias("phrase"))
    longer = inside.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < part * F.col("a")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("s.score"), F.desc("a"), "phrase"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("s.l").alias("l"), F.col("s.r").alias("r"), F.col("total").alias("n"), F.col("s.score").alias("score"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
places AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) AS ks(k)),
f AS MATERIALIZED (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM places GROUP BY ALL HAVING count(*) >= 100),
cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT lang, phrase, k, a, w, unnest(range(1, k)) AS cut FROM cand),
scored AS (
  SELECT c.lang, c.phrase, c.k, c.a, c.cut, l.a AS l, r.a AS r, n, ((1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM cuts c JOIN total USING (lang) JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1:], ' ')
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_runs AS (SELECT lang, k, a, w, b, unnest(range(b + 1, k + 1)) AS e FROM (SELECT *, unnest(range(1, k)) AS b FROM cand)),
covered AS (SELECT lang, array_to_string(w[b:e], ' ') AS phrase, max(a) AS most FROM inner_runs WHERE e - b + 1 < k GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN covered USING (lang, phrase) WHERE most IS NULL OR 100 * most < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
