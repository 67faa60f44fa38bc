"""Language ID by multilingual mixture inference.

Each language has a character-trigram model (hashed to ``BUCKETS`` counts, add-``ALPHA``
smoothing) counted over all training texts.  Each word of a document is drawn from one of the
languages; expectation-maximisation estimates the document's language proportions from the
words' trigram likelihoods, and languages leave the set while that raises the likelihood less
half a log of the number of words for each language (BIC).  The largest proportion is the score.

Null text, or no letter: ``und`` with score 0.  No training rows at all: ``und`` everywhere.
Equal proportions: the first language by code point.  Rows that repeat an id are rows of their
own; a null id is held out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import crc_mod, table
from ._text import chunks

BUCKETS = 1 << 16
ALPHA = 0.5
ROUNDS = 8
#: Languages whose counts a training task holds before it hands them on.
HELD = 64

LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets, the first trigram of each word, and each text's number of words.

    A word is a run of letters with the blank after it; a trigram belongs to the word in which it ends.
    """
    low = [t.lower() for t in texts]
    sizes = np.fromiter((len(t) + 3 for t in low), np.int64, len(low))
    c = np.frombuffer(("  " + "   ".join(low) + "   ").encode("utf-32-le", "surrogatepass"), np.uint32)
    # text i lies between blanks at begins[i] .. begins[i + 1]
    begins = np.concatenate([[0], np.cumsum(sizes)])
    letter = LETTER[c]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank after each word
    at = np.flatnonzero(keep)
    x = np.where(letter[at], c[at], 32).astype(np.uint32)
    if not len(x):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    starts = np.flatnonzero(np.concatenate([[True], x[:-1] == 32]))
    one = np.concatenate([np.array([32], np.uint32), x[:-1]])
    two = np.concatenate([np.array([32], np.uint32), one[:-1]])
    two[starts] = 32  # nothing reaches over a word's beginning
    h = (two * np.uint32(0x9E3779B1)) ^ (one * np.uint32(0x85EBCA77)) ^ (x * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    words = np.diff(np.searchsorted(at[starts], begins))
    return (h >> np.uint32(16)).astype(np.int64), starts, words


def count_ngrams(labelled: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, c in counts.items():
                some = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(c[some])], ["lang", "bucket", "n"])
            counts.clear()

        for batch in batches:
            for part in chunks(zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True)):
                by_lang: dict[str, list[str]] = {}
                for lang, text in part:
                    by_lang.setdefault(lang, []).append(text or "")
                for lang, texts in by_lang.items():
                    if lang not in counts:
                        if len(counts) >= HELD:
                            yield from out()
                        counts[lang] = np.zeros(BUCKETS, np.int64)
                    counts[lang] += np.bincount(trigrams(texts)[0], minlength=BUCKETS)
        yield from out()

    return labelled.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Log-probabilities (BUCKETS x languages) of the languages in order of code point."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        p = counts + ALPHA
        self.log_p = np.log(p / p.sum(0)).astype(np.float32)

    @classmethod
    def fit(cls, labelled: DataFrame) -> Model:
        """Learn from rows (lang, text); null languages are left out.  Fixed size for each language."""
        rows = count_ngrams(labelled.where(labelled["lang"].isNotNull())).toPandas()
        langs = sorted(rows["lang"].unique())
        counts = np.zeros((BUCKETS, len(langs)))
        if langs:
            counts[rows["bucket"].to_numpy(np.int64), np.searchsorted(np.array(langs, object), rows["lang"].to_numpy(object))] = rows["n"]
        return cls(langs, counts)

    def infer(self, texts: list[str | None]) -> list[tuple[str, float, str]]:
        """For each text: language, its proportion, and all chosen languages with proportions."""
        k, out = len(self.langs), [("und", 0.0, "")] * len(texts)
        h, starts, n = trigrams([t or "" for t in texts])
        some = np.flatnonzero(n)
        if not len(some) or not k:
            return out
        like = np.add.reduceat(self.log_p[h], starts, axis=0).astype(np.float64)
        top = like.max(1, keepdims=True)
        like = np.exp(like - top)
        counts = n[some]
        pi, _ = select(like, counts)
        best = pi.argmax(1)
        for row, i, j in zip(pi.tolist(), some.tolist(), best.tolist(), strict=True):
            out[i] = (self.langs[j], min(1.0, row[j]), ",".join(f"{lang}:{p:.3f}" for lang, p in zip(self.langs, row, strict=True) if p > 0))
        return out


def _em(like: np.ndarray, counts: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (documents x languages) among the allowed ones, and log-likelihoods."""
    first = np.cumsum(counts) - counts
    pi = allowed / allowed.sum(1, keepdims=True)
    for _ in range(rounds):
        r = like * np.repeat(pi, counts, axis=0) + 1e-300
        r /= r.sum(1, keepdims=True)
        pi = np.add.reduceat(r, first, axis=0) / counts[:, None] * allowed
        pi /= pi.sum(1, keepdims=True)
    return pi, np.add.reduceat(np.log((like * np.repeat(pi, counts, axis=0)).sum(1) + 1e-300), first)


def select(like: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after backward selection of each document's language set by penalised likelihood."""
    k = like.shape[1]
    allowed = np.ones((len(counts), k))
    pi, ll = _em(like, counts, allowed)
    todo = np.arange(len(counts))
    first = np.cumsum(counts) - counts
    for size in range(k, 1, -1):
        rows = np.concatenate([np.arange(first[i], first[i] + counts[i]) for i in todo]) if len(todo) < len(counts) else slice(None)
        fewer = allowed[todo]
        fewer[np.arange(len(todo)), np.where(fewer > 0, pi[todo], np.inf).argmin(1)] = 0
        pi2, ll2 = _em(like[rows], counts[todo], fewer)
        better = ll2 + 0.5 * np.log(counts[todo] + 1.0) >= ll[todo]
        done = todo[better]
        allowed[done], pi[done], ll[done] = fewer[better], pi2[better], ll2[better]
        todo = done
        if not len(todo):
            break
    return pi, ll


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, held_out, lang_pred, score, languages) from the texts alone."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True), 2):
                ids, held_out, texts = zip(*part, strict=True)
                lang, score, mix = zip(*held.value.infer(list(texts)), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held_out, pa.bool_()), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(mix, pa.string())], ["doc_id", "held_out", "lang_pred", "score", "languages"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), (crc_mod(id_col, 5) == 0).alias("held_out"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, languages string")


def drop_unidentified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text has a language."""
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = []
            for part in chunks(((t,) for t in batch.column(at).to_pylist()), 0):
                known += [lang != "und" for lang, _, _ in held.value.infer([t for (t,) in part])]
            yield batch.filter(pa.array(known, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of all rows that are not held out."""
    return Model.fit(docs.where(crc_mod(id_col, 5) != 0).select(docs[lang_col].alias("lang"), docs[text_col].alias("text")))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs))
