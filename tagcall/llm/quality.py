"""Quality by logistic regression on hashed word n-grams, learnt by follow-the-regularised-leader.

A word is a run of letters, a run of digits, or one mark repeated; a word that equals the one before
it counts as the mark of a repeat, so texts that stammer share n-grams whatever they repeat.  A
document's features are its runs of 1 to ``ORDERS`` words, hashed to ``BUCKETS``, with the value
1 + ln(count), scaled to length 1.  Its score is the logistic of a sparse dot product.

Learning: labelled rows are dealt by hash of their id to shards of about ``SHARD_ROWS``; each shard
is one task that passes over blocks of its rows with FTRL-proximal updates (a rate for each bucket,
L1 and L2), about ``UPDATES`` in all, so few labelled rows are passed over more often; and the model is the mean of the shards' weights, added up in Spark as
whole numbers, so reruns agree.  All labelled rows are learnt from; no more than ``BUCKETS`` weights
reach the driver.

Null or empty text: the score of no evidence.  Null ids count as not held out but have no label.
Several labels of one id: the highest.  Without labels of both kinds to learn from, every score is
the share of good rows (1 if there are none).  Rows that repeat an id are rows of their own; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import crc_mod, saved, small, table
from ._text import U, chunks, mix, powers

BUCKETS = 1 << 20
ORDERS = 2
#: Labelled rows of a task, of a block that is passed over several times while it is in memory, and updates of a task.
SHARD_ROWS, BLOCK_ROWS, UPDATES = 4000, 1000, 12_000
#: Rates of the updates: alpha / (beta + root of summed squared gradients), L1, L2.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.1, 0.1
THRESHOLD = 0.3
#: Weights are added up in units of 1 / UNIT.
UNIT = 1 << 30

# classes of bytes: blank, letter, digit; every other mark is a class of its own
_KIND = np.arange(256)
_KIND[[*range(0x09, 0x0E), 0x20]] = 0
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_KIND[[*range(0x30, 0x3A)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_REPEAT = U(0x5851F42D4C957F2D)


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts and each text's offsets."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    begins = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=begins[1:])
    b = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    kind = _KIND[b]
    start = np.flatnonzero(np.diff(kind, prepend=0) != 0)
    start = start[kind[start] > 0]
    off = np.searchsorted(start, begins)
    if not len(start):
        return np.empty(0, U), off
    end = np.flatnonzero(np.diff(kind, append=0) != 0)
    sizes = end[kind[end] > 0] + 1 - start
    at = np.flatnonzero(kind)
    firsts = np.cumsum(sizes) - sizes
    place = np.arange(len(at)) - np.repeat(firsts, sizes)
    h = mix(np.add.reduceat((_LOWER[b[at]].astype(U) + U(1)) * powers(int(sizes.max()))[place], firsts))
    again = np.flatnonzero(h[1:] == h[:-1]) + 1
    h[again[~np.isin(again, off)]] = _REPEAT
    return h, off


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct buckets of all texts, their values, and each text's offsets."""
    w, off = words(texts)
    n = len(off) - 1
    doc = np.repeat(np.arange(n), np.diff(off))
    h, keys = np.zeros(len(w), U), []
    for k in range(ORDERS):
        last = len(w) - k
        h = mix(h[:last] * U(0xD6E8FEB86659FD93) + w[k:] + U(k)) if last > 0 else h[:0]
        inside = doc[: max(last, 0)] == doc[k:] if k else slice(None)
        keys.append(doc[: max(last, 0)][inside] * BUCKETS + (h[inside] >> U(44)).astype(np.int64))
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    of, value = key // BUCKETS, 1 + np.log(count)
    at = np.searchsorted(of, np.arange(n + 1))
    norm = np.sqrt(np.bincount(of, value * value, minlength=n))
    return key % BUCKETS, value / norm[of], at


class Ftrl:
    """FTRL-proximal for the logistic loss; the bias has a rate of its own and no penalty."""

    def __init__(self):
        self.z, self.n, self.bias = np.zeros(BUCKETS), np.zeros(BUCKETS), [0.0, 0.0]

    def weights(self, i: np.ndarray | slice) -> np.ndarray:
        z = self.z[i]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(self.n[i])) / ALPHA + L2))

    def bias_weight(self) -> float:
        return -self.bias[0] / ((BETA + self.bias[1] ** 0.5) / ALPHA)

    def learn(self, bucket: np.ndarray, value: np.ndarray, y: float) -> None:
        w, b = self.weights(bucket), self.bias_weight()
        g = 1 / (1 + np.exp(-np.clip(b + w @ value, -30, 30))) - y
        step = g * value
        n = self.n[bucket]
        more = n + step * step
        self.z[bucket] += step - (np.sqrt(more) - np.sqrt(n)) / ALPHA * w
        self.n[bucket] = more
        root = self.bias[1] ** 0.5
        self.bias[1] += g * g
        self.bias[0] += g - (self.bias[1] ** 0.5 - root) / ALPHA * b


class Model:
    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight.astype(np.float32), bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        bucket, value, at = features(texts)
        doc = np.repeat(np.arange(len(texts)), np.diff(at))
        return 1 / (1 + np.exp(-np.clip(self.bias + np.bincount(doc, self.weight[bucket] * value, minlength=len(texts)), -30, 30)))


def _shard(batches: Iterator[pa.RecordBatch], passes: int) -> Iterator[pa.RecordBatch]:
    """The weights that one task learns from its rows (label, text), as (bucket, weight); bucket -1 is the bias."""
    model, seen = Ftrl(), 0

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True)

    def learn(block: list[tuple]) -> None:
        made = [(y, x[0][a:b], x[1][a:b]) for part in chunks(block) for x in [features([t for _, t in part])] for (y, _), a, b in zip(part, x[2][:-1], x[2][1:], strict=True)]
        for _ in range(passes):
            for y, bucket, value in made:
                model.learn(bucket, value, y)

    held: list[tuple] = []
    for row in rows():
        held.append(row)
        seen += 1
        if len(held) == BLOCK_ROWS:
            learn(held)
            held = []
    learn(held)
    if seen:
        w = model.weights(slice(None))
        some = np.flatnonzero(w)
        bucket = np.concatenate([[-1], some])
        weight = np.concatenate([[model.bias_weight()], w[some]])
        yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(np.rint(weight * UNIT).astype(np.int64))], ["bucket", "weight"])


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Labelled training rows (doc_id, good, text)."""
    one = saved(labels.where("quality IS NOT NULL").groupBy(F.col("doc_id").alias("label_id")).agg(F.max("quality").cast("long").alias("good")), "quality-labels")
    rows = docs.where(crc_mod(id_col, 5) != 0).select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return rows.join(small(one, 24), rows["doc_id"] == one["label_id"]).select("doc_id", "good", "text")


def fit(rows: DataFrame) -> Model:
    """Learn from labelled rows (doc_id, good, text)."""
    n, good = rows.agg(F.count("*"), F.coalesce(F.sum("good"), F.lit(0))).first()
    if good in (0, n):
        share = good / n if n else 1.0
        return Model(np.zeros(BUCKETS), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    shards = -(-n // SHARD_ROWS)
    dealt = rows.withColumn("order", F.xxhash64(F.lit(11), "doc_id")).repartition(shards, "order").sortWithinPartitions("order", "text")
    passes = -(-UPDATES * shards // n)
    learnt = saved(dealt.select("good", "text").mapInArrow(lambda batches: _shard(batches, passes), "bucket long, weight long"), "quality-shards")
    merged = learnt.groupBy("bucket").agg(F.sum("weight").alias("weight"), F.count("*").alias("n")).toPandas()  # BUCKETS rows at most
    bucket, weight = merged["bucket"].to_numpy(), merged["weight"].to_numpy() / UNIT
    tasks = int(merged.loc[bucket == -1, "n"].iloc[0])
    out = np.zeros(BUCKETS)
    out[bucket[bucket >= 0]] = weight[bucket >= 0] / tasks
    return Model(out, float(weight[bucket == -1][0] / tasks))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True), 2):
                ids, out, texts = zip(*part, strict=True)
                s = held.value.scores(list(texts))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.bool_()), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), (crc_mod(id_col, 5) == 0).alias("held_out"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(labelled(docs, table(spark, sf_dir, "labels"))))
