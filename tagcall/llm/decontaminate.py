"""Benchmark decontamination by latent semantic retrieval, then subsequence and answer checks.

Every document is coded once: a written table holds each word's number in the benchmark's
vocabulary, -1 for a word outside it, as such a word adds nothing to any inner product with an item.
All later steps read that table instead of the texts.

Passages are windows of two blocks of ``BLOCK`` words, one block apart, over whole documents.
They and the benchmark's items are TF-IDF vectors over the vocabulary, with document frequencies
over all documents.  Their latent space is a randomised SVD of the matrix A whose rows are the items
and the blocks of all documents, the latter with ``PASSAGES`` of the items' weight in all:

1. Range: the items' random combinations after a power step, and ``SKETCH`` random signed sums of all
   blocks.  The sums are taken in the pass that counts document frequencies; inverse frequencies are
   factors of columns, so they are applied afterwards.  Q is an orthonormal basis of these.
2. B = AQ: each task adds up B'B of its blocks, Spark adds up the tasks' cells.  The eigenvectors of B'B
   turn Q into right singular vectors, and the roots of its eigenvalues are the singular values.

The rank is the smallest at which every item keeps ``KEPT`` of its squared length.  Items of a block
that the directions found can't hold so far are taken again in blocks of ``RANK``, which always can.
Every passage of every document is projected and compared with every item by cosine.
Candidates are verified on the words around them: the longest common subsequence must hold
``LCS_SHARE`` of the item, and the answer check must pass: the item's answer, where there is one,
else ``ANSWER_SHARE`` of its telling words (the rarer half), must be there.

Items are taken in blocks of ``ITEMS``, so the broadcast model is bounded.  Null or empty texts have
no passages and null or empty items no words, so neither is ever a hit.  Items that repeat are
items of their own; rows that repeat an id give one row, as the result is one row for each pair.
Ids are integers (or text that holds integers).  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import saved, small, table
from ._text import U, chunks, mix, words

BLOCK = 32
#: Random directions of the items that the range holds, and signed sums of all documents' blocks.
RANK = 256
SKETCH = 64
#: Squared length that each item keeps in the latent space, and the blocks' weight in all against the items'.
KEPT = 0.9
PASSAGES = 0.1
ITEMS = 1024
COSINE = 0.45
LCS_SHARE = 0.6
LCS_WORDS = 8
ANSWER_SHARE = 0.5
#: A word in more than this share of documents does not count for retrieval, if its item has FEW others.
COMMON = 0.1
FEW = 5
_SLOTS = 1 << 20
#: Bytes of codes at once, and blocks that are projected at once, as each word takes a row of the basis.
CHUNK = 1 << 20
STEP = 512


class Items:
    """A block of benchmark items: vocabulary, word sequences, and later weights and latent vectors."""

    def __init__(self, rows: list[tuple]):
        self.ids = [r[0] for r in rows]
        h, off = words([r[1] for r in rows])
        answers, a_off = words([r[2] for r in rows])
        self.vocab = np.unique(np.concatenate([h, answers]))
        slot = (self.vocab >> U(44)).astype(np.int64)
        self.slot = np.full(_SLOTS, -1, np.int32)
        self.slot[slot] = np.arange(len(self.vocab))
        number = np.searchsorted(self.vocab, h)
        self.seq = [number[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
        numbers = np.searchsorted(self.vocab, answers)
        self.answers = [numbers[a:b] for a, b in zip(a_off[:-1], a_off[1:], strict=True)]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Each word's number in the vocabulary, or -1; words that share a slot are looked up one by one."""
        got = self.slot[(h >> U(44)).astype(np.int64)]
        hit = np.flatnonzero(got >= 0)
        exact = np.searchsorted(self.vocab, h[hit])
        exact[exact == len(self.vocab)] = 0
        got[hit] = np.where(self.vocab[exact] == h[hit], exact, -1)
        return got

    def weigh(self, df: np.ndarray, n_docs: int) -> None:
        self.idf = np.log((n_docs + 1) / (df + 1)) + 1e-3
        common = df > COMMON * n_docs
        self.weight = np.where(common, 0.0, self.idf)
        for s in self.seq:
            if np.count_nonzero(self.weight[np.unique(s)]) < FEW:
                self.weight[s] = self.idf[s]
        self.telling = []
        for s, a in zip(self.seq, self.answers, strict=True):
            own = np.unique(s)
            rare = own[np.argsort(-self.idf[own], kind="stable")][: (len(own) + 1) // 2]
            self.telling.append((frozenset(a.tolist()), True) if len(a) else (frozenset(rare.tolist()), False))
        self.masks = [{} for _ in self.seq]
        for m, s in zip(self.masks, self.seq, strict=True):
            for i, w in enumerate(s.tolist()):
                m[w] = m.get(w, 0) | 1 << i

        own = [np.unique(s, return_counts=True) for s in self.seq]
        self.row = np.repeat(np.arange(len(own)), [len(w) for w, _ in own])
        self.word = np.concatenate([w for w, _ in own])
        value = self.weight[self.word] * np.concatenate([n for _, n in own])
        length = np.sqrt(np.bincount(self.row, value**2, minlength=len(own)))
        self.value = value / np.maximum(length, 1e-12)[self.row]
        self.some = length > 0

    def times(self, q: np.ndarray) -> np.ndarray:
        """The items' unit TF-IDF rows times ``q`` (vocabulary x columns)."""
        out = np.zeros((len(self.seq), q.shape[1]))
        np.add.at(out, self.row, self.value[:, None] * q[self.word])
        return out

    def back(self, g: np.ndarray) -> np.ndarray:
        """The transposed rows times ``g`` (items x columns)."""
        out = np.zeros((len(self.vocab), g.shape[1]))
        np.add.at(out, self.word, self.value[:, None] * g[self.row])
        return out

    def embed(self, basis: np.ndarray) -> None:
        """Keep the latent space: words' projected weights, and the items as unit vectors.

        ``poor``: items that keep less than ``KEPT`` in the whole basis; the search leaves them out.
        """
        v = self.times(basis)
        kept = np.cumsum(v**2, axis=1)
        self.poor = self.some & (kept[:, -1] < KEPT)
        good = self.some & ~self.poor
        rank = int((kept[good] >= KEPT).argmax(1).max()) + 1 if good.any() else 1
        v = v[:, :rank] * good[:, None]
        self.latent = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        self.project = (basis[:, :rank] * self.weight[:, None]).astype(np.float32)

    def blocks(self, number: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Vocabulary words of each block: (block of each, its number), and each block's document and first word."""
        n = np.diff(off)
        blocks = -(-n // BLOCK)
        first_block = np.cumsum(blocks) - blocks
        doc_of = np.repeat(np.arange(len(n)), blocks)
        use = np.flatnonzero(number >= 0)
        doc = np.searchsorted(off, use, "right") - 1
        return first_block[doc] + (use - off[doc]) // BLOCK, number[use], doc_of, (np.arange(len(doc_of)) - first_block[doc_of]) * BLOCK

    def search(self, number: np.ndarray, off: np.ndarray) -> list[tuple[int, int, float, float, float, int, int]]:
        """Hits (text, item, cosine, lcs share, answer share, first word, end word), the best for each pair."""
        block, word, doc_of, begin = self.blocks(number, off)
        use = self.weight[word] > 0
        block, word = block[use], word[use]
        best: dict[tuple[int, int], tuple] = {}
        for lo in range(0, len(doc_of), STEP):
            hi = min(lo + STEP, len(doc_of))
            sums = summed(self.project, block, word, lo, min(hi + 1, len(doc_of)))
            joined = sums[: hi - lo].copy()
            same = np.flatnonzero(doc_of[lo + 1 : hi + 1] == doc_of[lo : min(hi, len(doc_of) - 1)])
            joined[same] += sums[same + 1]
            norm = np.linalg.norm(joined, axis=1)
            some = np.flatnonzero(norm > 1e-6)
            cos = (joined[some] / norm[some, None]) @ self.latent.T
            for i, item in zip(*np.nonzero(cos >= COSINE), strict=True):
                p = lo + some[i]
                d = int(doc_of[p])
                start, end = off[d], off[d + 1]
                room = max(BLOCK, len(self.seq[item]))
                a, b = max(start, start + begin[p] - room), min(end, start + begin[p] + 2 * BLOCK + room)
                lcs, told, ok = self.verify(number[a:b], int(item))
                if ok and (lcs, float(cos[i, item])) > best.get((d, int(item)), ((0.0, 0.0),))[0]:
                    best[d, int(item)] = ((lcs, float(cos[i, item])), told, int(a - start), int(b - start))
        return [(d, item, s[1], s[0], told, a, b) for (d, item), (s, told, a, b) in best.items()]

    def verify(self, near: np.ndarray, item: int) -> tuple[float, float, bool]:
        """Longest common subsequence share, share of the answer's words, and whether both suffice."""
        size = len(self.seq[item])
        words_, whole = self.telling[item]
        near_ = near[near >= 0].tolist()
        told = len(words_.intersection(near_)) / len(words_) if words_ else 1.0
        if told < (1.0 if whole else ANSWER_SHARE):
            return 0.0, told, False
        mask, full = self.masks[item], (1 << size) - 1
        own = [m for w in near_ if (m := mask.get(w))]
        least = max(LCS_SHARE * size, min(LCS_WORDS, size))
        if len(own) < least:
            return 0.0, told, False
        s = full
        for m in own:  # bit-parallel: a cleared bit is a matched word
            u = s & m
            s = ((s + u) | (s - u)) & full
        n = size - s.bit_count()
        return n / size, told, n >= least


def summed(rows: np.ndarray, block: np.ndarray, word: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """For each block from lo to hi the sum of its words' rows."""
    a, b = np.searchsorted(block, (lo, hi))
    out = np.zeros((hi - lo, rows.shape[1]), rows.dtype)
    if b > a:
        own, at = np.unique(block[a:b], return_index=True)
        out[own - lo] = np.add.reduceat(rows[word[a:b]], at, axis=0)
    return out


def coded(texts: DataFrame, items: Items) -> DataFrame:
    """(doc_id, codes) of rows (doc_id, text), written: words' numbers as 32-bit integers, empty without any."""
    held = texts.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(zip(*(c.to_pylist() for c in batch.columns), strict=True), 1):
                h, off = words([r[1] for r in part])
                number = held.value.find(h).astype("<i4")
                some = np.add.reduceat(np.append(number >= 0, False), off[:-1], dtype=np.int64) * (np.diff(off) > 0)
                raw = number.tobytes()
                codes = [raw[4 * a : 4 * b] if n else b"" for a, b, n in zip(off[:-1].tolist(), off[1:].tolist(), some.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array(codes, pa.binary())], ["doc_id", "codes"])

    return saved(texts.select("doc_id", "text").mapInArrow(run, "doc_id long, codes binary"), "decon-codes")


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Ids, numbers and offsets of coded rows."""
    for batch in batches:
        for part in chunks(zip(*(c.to_pylist() for c in batch.columns), strict=True), 1, CHUNK):
            ids, codes = zip(*part, strict=True)
            off = np.zeros(len(codes) + 1, np.int64)
            np.cumsum([len(c) // 4 for c in codes], out=off[1:])
            yield list(ids), np.frombuffer(b"".join(codes), "<i4"), off


def _cells(values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's sums as rows (cell, value) of those that aren't zero."""
    some = np.flatnonzero(values)
    for part in (some[i : i + (1 << 16)] for i in range(0, len(some), 1 << 16)):
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(values[part], pa.float64())], ["cell", "value"])


def _added(cells: DataFrame, n: int) -> np.ndarray:
    """The ``n`` cells' sums over all tasks; ``n`` is bounded by a block of items, not by the documents."""
    rows = cells.groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros(n)
    out[rows["cell"].to_numpy(int)] = rows["value"]
    return out


def statistics(codes: DataFrame, items: Items) -> tuple[np.ndarray, int, np.ndarray]:
    """Documents that hold each word, documents, and SKETCH signed sums of all blocks (SKETCH x vocabulary).

    A block counts its words' occurrences over the root of their number; its sum and sign are drawn by its
    document's id and place, so reruns agree.
    """
    held, v = codes.sparkSession.sparkContext.broadcast(items), len(items.vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((SKETCH + 1) * v + 1)
        df, sums = out[:v], out[v:-1]
        for ids, number, off in _numbers(batches):
            at = np.flatnonzero(number >= 0)
            doc = np.searchsorted(off, at, "right") - 1
            df += np.bincount(np.unique(doc * v + number[at]) % v, minlength=v)
            out[-1] += len(ids)
            block, word, doc_of, begin = held.value.blocks(number, off)
            own = np.array([i or 0 for i in ids], np.int64).view(U)[doc_of]
            h = mix(mix(own) + begin.astype(U))
            n = np.bincount(block, minlength=len(doc_of))
            scaled = np.where(h >> U(63), -1.0, 1.0) / np.sqrt(np.maximum(n, 1))
            np.add.at(sums, (h % U(SKETCH)).astype(np.int64)[block] * v + word, scaled[block])
        yield from _cells(out)

    out = _added(codes.mapInArrow(run, "cell long, value double"), (SKETCH + 1) * v + 1)
    return out[:v], int(out[-1]), out[v:-1].reshape(SKETCH, v)


def latent_basis(codes: DataFrame, items: Items, sums: np.ndarray, rank: int = RANK, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (vocabulary x directions) and singular values, largest first; see the module."""
    n = len(items.seq)
    random = np.random.default_rng(seed).standard_normal((n, min(n, rank)))
    y, _ = np.linalg.qr(items.back(random))
    q, _ = np.linalg.qr(np.hstack([items.back(items.times(y)), sums.T * items.weight[:, None]]))
    wide = q.shape[1]
    held = codes.sparkSession.sparkContext.broadcast((items, (q * items.weight[:, None]).astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items_, rows = held.value
        out = np.zeros(wide * wide + 1)
        gram = out[:-1].reshape(wide, wide)
        for _, number, off in _numbers(batches):
            block, word, doc_of, _ = items_.blocks(number, off)
            size = np.sqrt(np.maximum(np.bincount(block, minlength=len(doc_of)), 1)).astype(np.float32)
            use = items_.weight[word] > 0
            block, word = block[use], word[use]
            if not len(block):
                continue
            cell, times = np.unique(block * len(items_.vocab) + word, return_counts=True)
            out[-1] += ((times * items_.weight[cell % len(items_.vocab)] / size[cell // len(items_.vocab)]) ** 2).sum()
            for lo in range(0, len(doc_of), STEP):
                hi = min(lo + STEP, len(doc_of))
                b = summed(rows, block, word, lo, hi) / size[lo:hi, None]
                gram += b.T @ b
        yield from _cells(out)

    out = _added(codes.mapInArrow(run, "cell long, value double"), wide * wide + 1)
    share = PASSAGES * np.count_nonzero(items.some) / out[-1] if out[-1] else 0.0
    own = items.times(q)
    values, turn = np.linalg.eigh(own.T @ own + share * out[:-1].reshape(wide, wide))
    return q @ turn[:, ::-1], np.sqrt(np.maximum(values[::-1], 0))


_HITS = "doc_id long, item_id long, cosine double, lcs double, answer double, begin long, end long"


def _search(codes: DataFrame, items: Items) -> DataFrame:
    held = codes.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, number, off in _numbers(batches):
            cols = list(zip(*held.value.search(number, off), strict=True)) or [()] * 7
            values = [[ids[d] for d in cols[0]], [held.value.ids[i] for i in cols[1]], *cols[2:]]
            kinds = [pa.int64()] * 2 + [pa.float64()] * 3 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["doc_id", "item_id", "cosine", "lcs", "answer", "begin", "end"])

    return codes.mapInArrow(run, _HITS)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None) -> DataFrame:
    """Hits (doc_id, item_id, cosine, lcs, answer, begin, end): documents that hold an item or its paraphrase."""
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    answer = benchmark[answer_col] if answer_col else F.lit(None).cast("string")
    rows = benchmark.select(benchmark[item_col].cast("long").alias("item_id"), benchmark[item_text].alias("text"), answer.alias("answer"))
    source = (tuple(r) for r in rows.where(F.col("text").rlike("[^\\x20\\x09-\\x0D]")).orderBy("item_id", "text").toLocalIterator())
    found, again = None, []
    while part := again[:RANK] or list(islice(source, ITEMS)):
        again = again[RANK:]
        items = Items(part)
        codes = coded(texts, items)
        df, n_docs, sums = statistics(codes, items)
        items.weigh(df, n_docs)
        items.embed(latent_basis(codes, items, sums)[0])
        again += [part[i] for i in np.flatnonzero(items.poor)]
        hits = _search(codes, items)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return docs.sparkSession.createDataFrame([], _HITS)
    best = F.max(F.struct("lcs", "cosine", "answer", "begin", "end")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.cosine", "best.lcs", "best.answer", "best.begin", "best.end")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **columns: str) -> DataFrame:
    """The rows, with all their columns, whose documents hold no item of the benchmark."""
    hits = saved(decontaminate(docs, benchmark, id_col, **columns).select(F.col("doc_id").alias("hit_id")).distinct(), "decon-hits")
    return docs.join(small(hits, 24), docs[id_col].cast("long").eqNullSafe(hits["hit_id"]), "left_anti")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
