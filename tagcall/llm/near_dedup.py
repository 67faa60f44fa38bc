"""Near-duplicate documents by ProbMinHash, banding and exact verification.

A document is the weighted set of its five-word shingles; a shingle's weight is 1 + ln(how often it
occurs), so that a phrase repeated all over a text does not outweigh the rest.  Its arrivals are a Poisson process whose rate is the weight; each arrival goes to one of
``REGISTERS`` registers, which keep their earliest arrival's shingle, and a document stops once
its next arrivals come after all its registers' (ProbMinHash with interleaved elements).  Two
registers agree with the probability Jaccard similarity of the weighted sets.

Documents with one word sequence are one node.  ``BANDS`` hashes of ``REGISTERS / BANDS``
registers bring nodes together.  In each band bucket all nodes are verified against a few leaders
(the most central nodes) by the exact Jaccard similarity of their shingle sets; nodes that fail
stay in the bucket with new leaders, until no bucket has two nodes left.  Verified links join into
classes.  A node that a leader took never meets later leaders, and large buckets are split for the
rounds, so a last step takes each whole bucket again: all pairs of different classes are verified, in
large buckets those that an exact bound on sketches leaves.  So every pair that shares a bucket is in
one class or was verified.  There is no cap on buckets or partners.

Texts without words (null, empty, blanks) are classes of their own; texts of 1 to 4 words are one
shingle.  The smallest id of a class stays (null ids come last), of rows that repeat it one.  Rows that
repeat an id are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import saved, small, table
from ._text import U, chunks, fingerprints, mix, shingles, words
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
REGISTERS = 64
BANDS = 16
#: Leaders that a bucket's nodes meet in the first and in later rounds.
LEADERS = (4, 16)
#: Buckets of more nodes are split by each of the next SECOND bands for the rounds.  That alone would lose
#: 1.6 % of pairs at the threshold all of whose buckets are large, so ``_unsplit`` takes those buckets whole.
LARGE = 8
SECOND = 3
#: Members of a block of a whole bucket; pairs of blocks are compared as groups.
BLOCK = 512
#: Pairs of two classes that a pair of blocks gives at first, as one link is enough; all others come last.
FIRST = 32
#: Bits of a sketch for each shingle, at least.
SKETCH_BITS = 4
_CHUNK = 1 << 19


def distinct(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct hashes in order, offsets, and the weight of each."""
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    weights = 1 + np.log(np.diff(np.append(at, len(h))))
    return h[at], np.searchsorted(doc[at], np.arange(len(off))), weights


def prob_min_hash(h: np.ndarray, off: np.ndarray, weight: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Signatures (texts x registers) of the weighted sets; 0 everywhere for an empty set."""
    n = len(off) - 1
    doc = np.repeat(np.arange(n), np.diff(off))
    best = np.full(n * registers, np.inf)
    owner = np.zeros(n * registers, U)
    mixed = mix(h)
    live, arrival, seed, w, i = np.arange(len(h)), np.zeros(len(h)), mixed, weight.astype(float), 0
    at_doc = doc
    while len(live):
        i += 1
        r = mix(seed + U(i * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        arrival = arrival - np.log(((r >> U(12)).astype(float) + 0.5) * 2.0**-52) / w
        key = at_doc * registers + (mix(r) % U(registers)).astype(np.int64)
        np.minimum.at(best, key, arrival)
        first = best[key] == arrival
        owner[key[first]] = seed[first]
        limit = best.reshape(n, registers).max(1)
        go = arrival < limit[at_doc]
        live, arrival, seed, w, at_doc = live[go], arrival[go], seed[go], w[go], at_doc[go]
    return owner.reshape(n, registers)


def bands(signatures: np.ndarray, n_bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each band of registers."""
    rows = signatures.reshape(len(signatures), n_bands, -1)
    key = np.full((len(rows), n_bands), U(0)) + np.arange(1, n_bands + 1, dtype=U)
    for j in range(rows.shape[2]):
        key = mix(key + rows[:, :, j])
    return key


def _sign(docs: DataFrame) -> DataFrame:
    """(doc_id, th, fp, bands): fp is 128 bits of the word sequence, null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True), 2, _CHUNK):
                ids, th, texts = zip(*part, strict=True)
                w, off = words(list(texts))
                f1, f2 = fingerprints(w, off)
                keys = bands(prob_min_hash(*distinct(*shingles(w, off, SHINGLE))))
                some = np.diff(off) > 0
                fp = [x if s else None for x, s in zip(np.stack([f1, f2], 1).astype(">u8").view("V16")[:, 0].tolist(), some.tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(th, pa.int64()), pa.array(fp, pa.binary()), lists], ["doc_id", "th", "fp", "bands"])

    return docs.mapInArrow(run, "doc_id long, th long, fp binary, bands array<long>")


def _sets(texts: DataFrame) -> DataFrame:
    """(fp, grams): the sorted distinct shingle hashes (32 bits each) of rows (fp, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True), 1):
                fp, texts_ = zip(*part, strict=True)
                h, off = shingles(*words(list(texts_)), SHINGLE)
                h, off, _ = distinct(h >> U(32), off)
                raw = h.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(fp, pa.binary()), pa.array([raw[4 * a : 4 * b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.binary())], ["fp", "grams"])

    return texts.mapInArrow(run, "fp binary, grams binary")


def _jaccard(pairs: DataFrame) -> DataFrame:
    """(a, b, similarity) of rows (a, b, grams_a, grams_b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), "<u4") for v in (x, y))
                both = np.sort(np.concatenate([p, q]))
                shared = int((both[1:] == both[:-1]).sum())
                out.append(shared / (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["a", "b", "similarity"])

    return pairs.select("a", "b", "grams_a", "grams_b").mapInArrow(run, "a binary, b binary, similarity double")


def sketch(grams: np.ndarray) -> bytes:
    """Parities of the shingles' counts in a power of two of bits; its halves XORed are the sketch of half the bits."""
    bits = max(64, SKETCH_BITS << max(0, len(grams) - 1).bit_length())
    return np.packbits((np.bincount(grams & np.uint32(bits - 1), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _sketches(grams: DataFrame) -> DataFrame:
    """(fp, size, sketch) of rows (fp, grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(v.as_buffer(), "<u4") for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(g) for g in sets], pa.int64()), pa.array([sketch(g) for g in sets], pa.binary())], ["fp", "size", "sketch"])

    return grams.select("fp", "grams").mapInArrow(run, "fp binary, size long, sketch binary")


def possible(sketches: list[bytes], size: np.ndarray, label: np.ndarray, side: np.ndarray, similarity: float, most: int | None) -> tuple[list[int], list[int], list[bool]]:
    """Pairs (x, y, whether their two labels have more) that may reach ``similarity``, of different labels.

    Sketches that differ in d bits are of sets that differ in d shingles at least, so no pair that
    reaches it is missing.  side: where it has both values, only pairs across count.
    ``most``: of two labels only so many pairs, the likeliest.
    """
    share = (1 - similarity) / (1 + similarity)
    length = np.array([len(s) for s in sketches])
    rows = {n: np.flatnonzero(length == n) for n in np.unique(length).tolist()}
    bits = {n: np.frombuffer(b"".join(sketches[i] for i in at), np.uint64).reshape(len(at), -1) for n, at in rows.items()}
    across = len(np.unique(side)) > 1
    found = []
    for n, at in rows.items():
        others = [(at, bits[n], True)]
        if 2 * n in rows:  # sets of twice the size never reach 0.5, so only the next length is of use
            wide = bits[2 * n]
            others.append((rows[2 * n], wide[:, : wide.shape[1] // 2] ^ wide[:, wide.shape[1] // 2 :], False))
        for to, their, same in others:
            for k, x in enumerate(at.tolist()):
                y, v = (to[k + 1 :], their[k + 1 :]) if same else (to, their)
                ok = (label[y] != label[x]) & (np.minimum(size[y], size[x]) >= similarity * np.maximum(size[y], size[x]) - 1e-6)
                if across:
                    ok &= side[y] != side[x]
                y, v = y[ok], v[ok]
                apart = np.bitwise_count(v ^ bits[n][k]).sum(1, dtype=np.int64)
                near = apart <= (size[y] + size[x]) * share + 1e-6
                if near.any():
                    found.append((np.full(near.sum(), x), y[near], apart[near] / (size[y] + size[x])[near]))
    if not found:
        return [], [], []
    x, y, apart = (np.concatenate(c) for c in zip(*found, strict=True))
    more = np.zeros(len(x), bool)
    if most is not None:
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        order = np.lexsort((apart, high, low))
        x, y, low, high = x[order], y[order], low[order], high[order]
        new = np.ones(len(x), bool)
        new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        first = np.flatnonzero(new)
        counts = np.diff(np.append(first, len(x)))
        rank = np.arange(len(x)) - np.repeat(first, counts)
        keep = rank < most
        x, y, more = x[keep], y[keep], np.repeat(counts > most, counts)[keep]
    return x.tolist(), y.tolist(), more.tolist()


def _unsplit(members: DataFrame, sketches: DataFrame, similarity: float, most: int | None) -> DataFrame:
    """Pairs (a, b, more) of members (key, n, fp, label) of whole buckets that the bound leaves, across labels."""

    def run(table_: pa.Table) -> pa.Table:
        fp = table_.column("fp").to_pylist()
        _, label = np.unique(np.array(table_.column("label").to_pylist(), dtype=object), return_inverse=True)
        x, y, more = possible(table_.column("sketch").to_pylist(), table_.column("size").to_numpy(), label, table_.column("block").to_numpy(), similarity, most)
        a, b = [min(fp[i], fp[j]) for i, j in zip(x, y, strict=True)], [max(fp[i], fp[j]) for i, j in zip(x, y, strict=True)]
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(more, pa.bool_())], ["a", "b", "more"])

    blocks = F.floor(F.col("n") / BLOCK) + 1
    placed = members.withColumn("block", F.pmod(F.xxhash64("fp", F.lit(7)), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = placed.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp", "label").join(sketches, "fp")
    return placed.groupBy("key", "i", "j").applyInArrow(run, "a binary, b binary, more boolean")


def near_labels(signed: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, label) of the classes of nodes with links; texts has (doc_id, th, text)."""
    nodes = signed.where("fp IS NOT NULL").groupBy("fp").agg(F.min(F.struct("doc_id", "th")).alias("of"), F.first("bands").alias("bands"))
    nodes = saved(nodes.select("fp", "of.doc_id", "of.th", "bands"), "near-nodes", signed.count())
    n = nodes.count()
    members = nodes.select("fp", F.posexplode("bands").alias("band", "key")).select("fp", "band", F.xxhash64("band", "key").alias("key"))
    sizes = saved(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "near-buckets", BANDS * n)
    members = whole = saved(members.join(sizes, "key"), "near-members", BANDS * n)
    n_whole = whole.count()
    # A large bucket holds near copies, or texts that share one heavy shingle: a second band tells them apart.
    large = members.where(F.col("n") > LARGE).join(nodes.select("fp", "bands"), "fp")
    second = F.array(*(F.struct(F.lit(i).alias("i"), F.col("bands")[i].alias("v")) for i in range(BANDS)))
    split = large.select("fp", "band", "key", F.explode(second).alias("o")).where((F.pmod(F.col("o.i") - F.col("band"), F.lit(BANDS)) >= 1) & (F.pmod(F.col("o.i") - F.col("band"), F.lit(BANDS)) <= SECOND))
    split = saved(split.select(F.xxhash64("key", "o.i", "o.v").alias("key"), "fp"), "near-split", SECOND * n_whole)
    split_sizes = saved(split.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "near-split-buckets", split.count())
    members = saved(members.where(F.col("n") <= LARGE).select("key", "fp", "n").union(split.join(split_sizes, "key").select("key", "fp", "n")), "near-candidates", n_whole + split.count())
    central = saved(members.groupBy("fp").agg(F.sum("n").alias("weight")), "near-central", members.count())
    members = saved(members.select("key", "fp").join(central, "fp"), "near-open", members.count())

    wanted = nodes.join(whole.select("fp").distinct(), "fp").select("fp", "doc_id", "th")
    wanted = saved(wanted.withColumnRenamed("doc_id", "of_id"), "near-wanted", n_whole + n)
    found = texts.join(small(wanted, 64), "th").where(F.col("doc_id").eqNullSafe(F.col("of_id"))).select("fp", "text")
    grams = saved(_sets(found).dropDuplicates(["fp"]), "near-sets")

    def judge(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(grams.select(F.col("fp").alias("a"), F.col("grams").alias("grams_a")), "a")
        return saved(_jaccard(with_a.join(grams.select(F.col("fp").alias("b"), F.col("grams").alias("grams_b")), "b")), "near-judged", pairs.count(), 2000)

    tried_pairs = nodes.sparkSession.createDataFrame([], "a binary, b binary, similarity double")
    for round_ in count():
        m = members.count()
        slots = LEADERS[min(round_, len(LEADERS) - 1)]
        lead = members.groupBy("key", F.pmod(F.xxhash64("fp", F.lit(round_)), F.lit(slots)).alias("slot")).agg(F.count("*").alias("n"), F.max(F.struct("weight", "fp")).alias("lead"))
        lead = lead.select("key", F.col("lead.fp").alias("b"), F.sum("n").over(Window.partitionBy("key")).alias("n"))  # as many rows as slots
        lead = saved(lead.where("n > 1").select("key", "b"), "near-leaders", m)
        led = saved(members.join(lead, "key").where("fp <> b"), "near-led", m)
        n_led = led.count()
        pairs = saved(led.select(F.least("fp", "b").alias("a"), F.greatest("fp", "b").alias("b")).distinct(), "near-pairs", n_led)
        if not pairs.limit(1).count():
            break
        judged = judge(pairs)
        tried_pairs = tried_pairs.union(judged)
        good = judged.where(F.col("similarity") >= similarity)
        linked = good.select(F.col("a").alias("lo"), F.col("b").alias("hi"), F.lit(1).alias("ok"))
        tried = led.join(linked, (F.least("fp", "b") == F.col("lo")) & (F.greatest("fp", "b") == F.col("hi")), "left").groupBy("key", "fp").agg(F.max("weight").alias("weight"), F.max("ok").alias("ok"))
        # leaders have met every member, so they leave, as do those that a leader took
        members = saved(tried.where("ok IS NULL").join(lead.select("key", F.col("b").alias("fp")), ["key", "fp"], "left_anti").select("key", "fp", "weight"), "near-open", n_led)

    # The rounds left pairs out, of nodes already taken and of large buckets: all those of different classes.
    open_ = whole.where("n > 2").select("key", "n", "fp")  # two nodes have met
    sketches = None
    for most in (FIRST, None):
        label = components(tried_pairs.where(F.col("similarity") >= similarity), "near")
        placed = saved(open_.join(label, open_["fp"] == label["node"], "left").select("key", "n", "fp", F.coalesce("label", "fp").alias("label")), "near-placed", n_whole)
        mixed = saved(placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key"), "near-mixed", n_whole)
        placed = saved(placed.join(mixed, "key"), "near-across", n_whole)
        if not placed.limit(1).count():
            return label
        large = placed.where(F.col("n") > LARGE)
        if sketches is None:
            sketches = saved(_sketches(grams.join(large.select("fp").distinct(), "fp")), "near-sketches")
        left = _unsplit(large, sketches, similarity, most)
        if most:
            few = placed.where(F.col("n") <= LARGE)
            others = few.select("key", F.col("fp").alias("b"), F.col("label").alias("label_b"))
            left = left.union(few.join(others, "key").where("fp < b AND label <> label_b").select(F.col("fp").alias("a"), "b", F.lit(False).alias("more")))
        left = saved(left, "near-left")
        pairs = saved(left.select("a", "b").distinct().join(tried_pairs, ["a", "b"], "left_anti"), "near-left-pairs", left.count())
        judged = judge(pairs)
        tried_pairs = tried_pairs.union(judged)
        found = judged.where(F.col("similarity") >= similarity).limit(1).count()
        if not left.where("more").limit(1).count():
            break
    return components(tried_pairs.where(F.col("similarity") >= similarity), "near") if found else label


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row for each input row: doc_id, th (hash of the text), keep_id, group_size, kept.

    Of a class the row with the smallest (id, th) stays, of rows that repeat both one.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("th"), docs[text_col].alias("text"))
    signed = saved(_sign(rows).withColumn("row", F.monotonically_increasing_id()), "near-signed")
    label = near_labels(signed, rows, similarity)
    n_rows = signed.count()
    rows_of = signed.select("doc_id", "th", "fp", "row")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "row")
    by_node = rows_of.where("fp IS NOT NULL").groupBy("fp").agg(F.count("*").alias("n"), F.min(order).alias("low"))
    by_node = saved(by_node.join(label, by_node["fp"] == label["node"], "left").select("fp", "n", "low", F.coalesce("label", "fp").alias("label")), "near-by-node", n_rows)
    groups = saved(by_node.groupBy("label").agg(F.sum("n").alias("group_size"), F.min("low").alias("keep")), "near-groups", n_rows)
    classes = saved(by_node.select("fp", "label").join(groups, "label").select("fp", "group_size", "keep"), "near-classes", n_rows)
    out = rows_of.join(classes, "fp", "left")
    own = F.col("group_size").isNull()
    return out.select("doc_id", "th", F.when(own, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (own | (F.col("keep.row") == F.col("row"))).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row for each input row: id, keep_id (its class), group_size, kept."""
    return near_classes(docs, id_col, text_col, similarity).select(F.col("doc_id").alias(id_col), "keep_id", "group_size", "kept")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows, with all their columns, that stay: one of each class, of rows that repeat it one."""
    classes = saved(near_classes(docs, id_col, text_col, similarity), "near-decided")
    by_row = classes.where("group_size > 1").groupBy("doc_id", "th").agg(F.count("*").alias("rows"), F.max("kept").alias("kept"))
    by_row = saved(by_row.where("NOT kept OR rows > 1").select(F.col("doc_id").alias("of_id"), F.col("th").alias("of_th"), "kept"), "near-gone")
    again = by_row.where("kept")
    this = lambda df, side: df[id_col].cast("long").eqNullSafe(side["of_id"]) & (F.xxhash64(F.coalesce(df[text_col], F.lit(""))) == side["of_th"])
    if not again.limit(1).count():
        return docs.join(small(by_row, 32), this(docs, by_row), "left_anti")
    out = docs.join(small(by_row, 32), this(docs, by_row), "left_anti")
    return out.union(docs.join(small(again, 32), this(docs, again), "left_semi").dropDuplicates([id_col, text_col]))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))
