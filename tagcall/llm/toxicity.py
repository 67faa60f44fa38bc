"""Toxicity by a counterfactual-regularised classifier over word pieces.

A word's evidence is the largest weight of its pieces: the whole word and its first 3, 4, 5 and 6
letters, hashed to ``BUCKETS``.  A document's logit is linear in the evidence of its ``BEST``
strongest distinct words, wherever they stand, so length does not dilute it.  A piece's weight begins as a lower
bound of its log-odds over all labelled training rows; then gradient descent on about ``SAMPLE``
labelled rows at most fits bias, slopes and weights, where each row's own count is taken out of its
weights, and the squared change of the logit when identity terms of its text are swapped for
others of their group (the text's hash says which) is added to the loss.  So a group's name keeps no weight of its own.

Null or empty text, or one without letters: the score of no evidence.  Null ids count as not held
out but have no label.  Several labels of one id: the highest.  Without both labels to learn from,
every score is the share of toxic rows (0 if there are none).  Rows that repeat an id are rows of
their own; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import crc_mod, saved, small, table
from ._text import U, chunks, mix, powers
from .language import LETTER

BUCKETS = 1 << 20
PREFIXES = (3, 4, 5, 6)
#: Labelled rows that the gradient fit sees, give or take one in a hundred, by hash of the id; all of them
#: if there are no more.  Counts see all rows.
SAMPLE = 20_000
#: Strongest words that count, and those of a row that the gradient fit sees.
BEST = 3
TOP = 12
#: Evidence below this is none.
LEAST = 0.7
PRIOR = 0.5
THRESHOLD = 0.7
SWAP_PENALTY = 1.0
#: Neutral names of groups of people, each list a class whose members may be swapped.
IDENTITY = (
    ("women", "men", "girls", "boys", "mothers", "fathers", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "muslime", "christen", "juden", "musulmans", "chrétiens", "juifs", "musulmanes", "cristianos", "judíos"),
    ("black", "white", "asian", "african", "european", "arab", "latino", "indigenous"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer", "homosexual", "heterosexual"),
    ("german", "french", "spanish", "turkish", "polish", "mexican", "chinese", "indian", "russian", "american"),
    ("deaf", "blind", "disabled", "elderly", "young", "old"),
    ("immigrants", "refugees", "locals", "citizens", "migranten", "flüchtlinge", "immigrés", "réfugiés", "inmigrantes", "refugiados"),
)
_CLASS = {w: c for c in IDENTITY for w in c}
_TERM = re.compile(r"\b(?:" + "|".join(sorted(_CLASS)) + r")\b", re.I)


def swapped(text: str, turn: int = 0) -> str:
    """The text with every identity term replaced by another of its class; ``turn`` says which.

    A word that only case folding beyond lower case makes a term stays as it is.
    """

    def other(m: re.Match) -> str:
        word = m[0].lower()
        if word not in _CLASS:
            return m[0]
        c = _CLASS[word]
        return c[(c.index(word) + 1 + turn % (len(c) - 1)) % len(c)]

    return _TERM.sub(other, text)


def pieces(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the pieces of every word (words x 5; 0 stands for none), and each text's words."""
    low = [t.lower() for t in texts]
    sizes = np.fromiter((len(t) + 1 for t in low), np.int64, len(low))
    c = np.frombuffer((" ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    letter = LETTER[c]
    edge = np.flatnonzero(np.diff(letter, prepend=False, append=False))
    start, size = edge[0::2], edge[1::2] - edge[0::2]
    off = np.searchsorted(start, begins)
    if not len(start):
        return np.zeros((0, 1 + len(PREFIXES)), np.int64), off
    at = np.flatnonzero(letter)
    first = np.cumsum(size) - size
    place = np.arange(len(at)) - np.repeat(first, size)
    part = c[at].astype(U) * powers(int(size.max()))[place]
    total = np.cumsum(part)
    base = total[first] - part[first]
    out = np.zeros((len(start), 1 + len(PREFIXES)), np.int64)
    for j, n in enumerate((0, *PREFIXES)):
        has = np.flatnonzero(size >= n)
        end = first[has] + (n or size[has]) - 1
        h = mix(total[end] - base[has] + U(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        out[has, j] = (h >> U(44)).astype(np.int64) | 1
    return out, off


def _rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Labelled training rows (doc_id, toxic, text)."""
    one = saved(labels.where("toxic IS NOT NULL").groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").cast("long").alias("toxic")), "toxic-labels")
    rows = docs.where(crc_mod(id_col, 3) != 1).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.join(small(one, 24), rows["doc_id"] == one["label_id"]).select("doc_id", "toxic", "text")


def _counts(rows: DataFrame) -> DataFrame:
    """(bucket, toxic, n): labelled rows that hold a piece; bucket 0 counts the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for part in chunks(zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True)):
                toxic, texts = zip(*part, strict=True)
                p, off = pieces([t or "" for t in texts])
                y = np.array(toxic)
                doc = np.repeat(np.arange(len(y)), np.diff(off))
                each = np.unique((doc[:, None] * BUCKETS + p).ravel())
                each = each[each % BUCKETS > 0]
                for label in (0, 1):
                    held[label] += np.bincount(each[y[each // BUCKETS] == label] % BUCKETS, minlength=BUCKETS)
                    held[label, 0] += int((y == label).sum())
        for label in (0, 1):
            some = np.flatnonzero(held[label])
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), label)), pa.array(held[label][some])], ["bucket", "toxic", "n"])

    return rows.select("toxic", "text").mapInArrow(run, "bucket long, toxic long, n long").groupBy("bucket", "toxic").agg(F.sum("n").alias("n"))


def bound(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    """A lower bound (one standard error) of the log-odds of a piece."""
    t, c = np.maximum(toxic, 0) + PRIOR, np.maximum(clean, 0) + PRIOR
    return np.log(t / (n_toxic + 2 * PRIOR)) - np.log(c / (n_clean + 2 * PRIOR)) - np.sqrt(1 / t + 1 / c)


def strongest(p: np.ndarray, off: np.ndarray, weight: np.ndarray, top: int) -> np.ndarray:
    """Each text's pieces (texts x top) that are the evidence of its strongest distinct words; 0 for none."""
    w = weight[p]
    best = w.argmax(1) if len(p) else np.empty(0, np.int64)
    some = np.flatnonzero(w.max(1) >= LEAST) if len(p) else best
    out = np.zeros((len(off) - 1, top), np.int64)
    if len(some):
        doc = np.searchsorted(off, some, "right") - 1
        word, piece = p[some, 0], p[some, best[some]]
        _, first = np.unique(doc * BUCKETS + word, return_index=True)
        doc, piece = doc[first], piece[first]
        order = np.lexsort((piece, -weight[piece], doc))
        doc, piece = doc[order], piece[order]
        rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
        out[doc[rank < top], rank[rank < top]] = piece[rank < top]
    return out


class Model:
    def __init__(self, weight: np.ndarray, bias: float, slope: np.ndarray):
        self.weight, self.bias, self.slope = weight.astype(np.float32), bias, slope

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = self.weight[strongest(*pieces([t or "" for t in texts]), self.weight, BEST)]
        return 1 / (1 + np.exp(-np.clip(self.bias + x @ self.slope, -30, 30)))


def fit(rows: DataFrame, penalty: float = SWAP_PENALTY, sample: int = SAMPLE, rounds: int = 300) -> Model:
    """Learn from labelled rows (doc_id, toxic, text)."""
    rows = saved(rows, "toxic-train")
    counts = _counts(rows).toPandas()  # BUCKETS rows a label at most
    n = np.zeros((2, BUCKETS))
    n[counts["toxic"].to_numpy(int), counts["bucket"].to_numpy(int)] = counts["n"]
    n_clean, n_toxic = n[0, 0], n[1, 0]
    n[:, 0] = 0
    if not n_clean or not n_toxic:
        share = n_toxic / max(1.0, n_clean + n_toxic)
        return Model(np.zeros(BUCKETS), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), np.zeros(BEST))
    z = bound(n[1], n[0], n_toxic, n_clean)
    z[0] = 0
    z[(n[1] < 2) | (z < LEAST)] = 0
    held = rows.sparkSession.sparkContext.broadcast(z.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True)):
                toxic, texts = zip(*part, strict=True)
                seen = [strongest(*pieces(x), held.value, TOP) for x in ([t or "" for t in texts], [swapped(t or "", crc32((t or "").encode("utf-8", "surrogatepass"))) for t in texts])]
                kind = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int64()), pa.array([x.tolist() for x in seen[0]], kind), pa.array([x.tolist() for x in seen[1]], kind)], ["toxic", "own", "swap"])

    share = min(1.0, sample / (n_clean + n_toxic))
    some = rows.where(F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("toxic", "text")
    got = some.mapInArrow(run, "toxic long, own array<long>, swap array<long>").toPandas()
    y = got["toxic"].to_numpy(float)

    own, swap = (np.array(got[c].tolist(), np.int64).reshape(len(y), TOP) for c in ("own", "swap"))

    # what a row's own label adds to its pieces' weights is not evidence about that row
    def without_own(x: np.ndarray) -> np.ndarray:
        less = bound(n[1][x] - y[:, None], n[0][x] - (1 - y[:, None]), n_toxic - y[:, None], n_clean - (1 - y[:, None]))
        return np.where(x > 0, less - z[x], 0.0)

    less_own, less_swap = without_own(own), without_own(swap)
    weight, bias, slope = np.where(z > 0, z, 0.0), -3.0, np.array([1.0] + [0.5] * (BEST - 1))
    start = weight.copy()
    balance = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    balance = 0.3 * balance + 0.7 / len(y)
    changed = (own != swap).any(1)

    def top(x: np.ndarray, less: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = np.where(x > 0, np.maximum(weight[x] + less, 0), 0)
        at = np.argsort(-v, axis=1, kind="stable")[:, :BEST]
        return np.take_along_axis(v, at, 1), np.take_along_axis(x, at, 1)

    for r in range(rounds):
        rate = 0.5 / (1 + r / 100)
        (va, xa), (vb, xb) = top(own, less_own), top(swap, less_swap)
        p = 1 / (1 + np.exp(-np.clip(bias + va @ slope, -30, 30)))
        g = balance * (p - y)
        gap = np.where(changed, (va - vb) @ slope, 0.0) * penalty / max(1, changed.sum())
        d = np.zeros(BUCKETS)
        np.add.at(d, xa, np.where(va > 0, (g + gap)[:, None] * slope, 0))
        np.add.at(d, xb, np.where(vb > 0, -gap[:, None] * slope, 0))
        d[0] = 0
        weight = np.maximum(weight - rate * 20 * d - rate * 0.002 * (weight - start), 0)
        bias -= rate * 8 * float(g.sum())
        slope = np.maximum(slope - rate * (g @ va + gap @ (va - vb)), 0.05)
    return Model(weight, bias, slope)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: id, held_out, score, predicted."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True), 2):
                ids, out, texts = zip(*part, strict=True)
                s = held.value.scores(list(texts))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.bool_()), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), (crc_mod(id_col, 3) == 1).alias("held_out"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    return fit(_rows(docs, labels, id_col, text_col))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))
