"""Near passages, families that drift, and keys of very many members."""

import random

import numpy as np
import pytest

from tagcall.llm import _spark, passages

AROUND = 90


def invented(r, n):
    return [f"w{r.randrange(1 << 40)}" for _ in range(n)]


def in_documents(spark, r, held):
    rows = [(i, " ".join(invented(r, AROUND) + p + invented(r, AROUND))) for i, p in enumerate(held)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def similarity(a, b):
    x, y = ({tuple(p[i : i + 5]) for i in range(len(p) - 4)} for p in (a, b))
    return len(x & y) / len(x | y)


def found(docs, held):
    """Documents in which most of the planted passage was found."""
    rows = passages.repeated_passages(docs).collect()
    return {x["doc_id"] for x in rows if min(x["end"], AROUND + len(held[x["doc_id"]])) - max(x["begin"], AROUND) > len(held[x["doc_id"]]) / 2}


@pytest.mark.parametrize(("n_words", "about"), [(50, 0.8), (100, 0.9)])
def test_recall_of_near_passages(spark, n_words, about):
    r = random.Random(n_words)
    held = []
    for _ in range(150):
        p = invented(r, n_words)
        q = list(p)
        q[n_words // 2] = "other"
        assert about <= similarity(p, q) < about + 0.01
        held += [p, q]
    got = found(in_documents(spark, r, held), held)
    assert sum(2 * k in got and 2 * k + 1 in got for k in range(150)) >= 0.9 * 150


@pytest.mark.parametrize("heavy", [8, 64])
def test_families_that_drift(spark, monkeypatch, heavy):
    monkeypatch.setattr(passages, "HEAVY", heavy)
    r = random.Random(heavy)
    held = []
    for _ in range(3):
        p = invented(r, 120)
        for _ in range(60):
            held.append(list(p))
            p[r.randrange(len(p))] = invented(r, 1)[0]
    need = {i for i, p in enumerate(held) if any(i != j and similarity(p, q) >= 0.8 for j, q in enumerate(held))}
    assert len(need) == 180
    assert len(found(in_documents(spark, r, held), held) & need) >= 0.97 * len(need)


def test_hot_keys_and_leaders_are_dealt(spark, monkeypatch):
    r = random.Random(4)
    p = invented(r, 80)
    docs = in_documents(spark, r, [p] * 40 + [invented(r, 60)] * 3 + [invented(r, 60) for _ in range(20)])
    rows = lambda: sorted(map(tuple, passages.repeated_passages(docs).collect()))
    plain = rows()
    assert {x[0] for x in plain} == set(range(43))
    monkeypatch.setattr(passages, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(_spark, "DEAL", 2)
    assert rows() == plain


def test_salted_join_is_an_inner_join(spark, monkeypatch):
    monkeypatch.setattr(_spark, "DEAL", 5)
    rows = _spark.saved(spark.createDataFrame([(k, i) for i in range(200) for k in (["hot"] if i % 3 else ["hot", f"k{i % 7}", None, "alone"])], "k string, v long"), "test-rows")
    side = spark.createDataFrame([("hot", 1), *((f"k{i}", 2) for i in range(5)), ("unmet", 3)], "k string, x long")
    hot = _spark.hot_keys(rows, "k")
    assert {x["k"]: x["salts"] for x in hot.collect() if x["k"]}["hot"] == 40
    assert sorted(map(tuple, _spark.salted_join(rows, side, "k", "v", hot).select("k", "v", "x").collect())) == sorted(map(tuple, rows.join(side, "k").select("k", "v", "x").collect()))


def test_heavy_keys_give_way_to_joins_with_all_others():
    n = passages.KEYS
    key, bits, open_ = np.arange(100, 100 + n), 1 << np.arange(n), np.ones(n, bool)
    pos = np.arange(n) << 2 * passages._BITS | 10 << passages._BITS | 90

    def joined(*heavy):
        k, p, b, _ = passages.deepened(key, pos, bits, open_, np.isin(np.arange(n), heavy))
        return {int(x): int(y) for x, y in zip(b, k, strict=True)}, len(k)

    by_two, n_two = joined(2, 5)
    assert n_two == n - 2 + 2 * (n - 1) - 1
    for one in (2, 5):  # one text's key may be heavy where the other of its two is not
        alone, n_alone = joined(one)
        assert n_alone == n - 1 + n - 1
        assert {b: k for b, k in alone.items() if b.bit_count() == 2}.items() <= by_two.items()
    assert {b for b in by_two if b.bit_count() == 2} == {1 << i | 1 << j for i in (2, 5) for j in range(n) if i != j}


def test_what_was_verified_is_a_row_for_each_place(spark):
    spans = [{"a0": 5, "a1": 60 + i, "b0": 0, "b1": 55, "similarity": 1.0} for i in range(50)]
    rows = [(1, 2, True, False, spans[i : i + 1], [{"b0": 0, "b1": 55}]) for i in range(50)] + [(1, 3, False, True, spans[:1], [])]
    got = passages._verified(spark.createDataFrame(rows, passages._JUDGED)).collect()
    assert sorted((x["nid"], x["lo"], x["hi"], x["other"], x["same"]) for x in got) == [(1, 5, 60, 0, False), (1, 5, 109, 2, False), (2, 0, 55, 0, False), (2, 0, 55, 0, True), (3, 0, 55, 1, False)]


def test_a_family_of_copies_with_own_changes_does_not_meet_all_with_all(spark, monkeypatch):
    """Texts far from their leader meet where they share a change of it."""
    r = random.Random(6)
    base = invented(r, 300)
    held = [list(base)]
    for _ in range(80):
        held.append([w if r.random() > 0.06 else f"x{r.randrange(1 << 40)}" for w in base])
    core = base[100:160]
    core[::5] = invented(r, 12)
    for i in (5, 9):  # two copies that share changes, too many for the base to hold their passage; one word differs
        held[i] = invented(r, 100) + core + invented(r, 140)
    held[9][130] = "other"
    verified = []
    plain = passages.saved

    def counted(df, name, *rest):
        out = plain(df, name, *rest)
        if name.startswith("passage-judged"):
            verified.append(out.count())
        return out

    monkeypatch.setattr(passages, "saved", counted)
    got = passages.repeated_passages(in_documents(spark, r, held)).collect()
    assert sum(verified) < 81 * 80 / 4  # most of all pairs when every open member met all of its key
    for i in (5, 9):
        assert any(x["begin"] <= AROUND + 105 and x["end"] >= AROUND + 155 for x in got if x["doc_id"] == i)
