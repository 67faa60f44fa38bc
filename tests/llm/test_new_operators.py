"""Quality, collocations and conversation repair: SQL, brute force, held-out labels and odd inputs."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tagcall.llm import collocations, conversations, quality
from tagcall.llm.queries import ORACLE, QUERIES

DOCS = "doc_id long, text string, lang string, source string, phrase string, k string, n string, good string, score string"
CONV = "conv_id long, turn long, role string, text string, sha string, audit string, row string, kind string"


def docs(spark, rows):
    """(id, text, lang) with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(*r, "s", "x", "x", "x", "x", "x") for r in rows], DOCS)


def sql(data, name, table):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    return con.sql(ORACLE[name])


# ---------------------------------------------------------------- quality

def test_quality_held_out(spark, data):
    big = data.replace("0.001", "0.01")
    rows = QUERIES["op11_quality"](spark, big).collect()
    good = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{big}/labels.parquet'").fetchall())
    assert len(rows) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in good]
    best = np.mean([(a["score"] > b["score"]) for a in held if good[a["doc_id"]] for b in held if not good[b["doc_id"]]])
    assert best >= 0.99 and np.mean([r["predicted"] == good[r["doc_id"]] for r in held]) >= 0.9


def test_quality_words_and_features():
    same = lambda a, b: np.array_equal(quality.words([a])[0], quality.words([b])[0])
    assert same("A b,c", "a  B ,  C") and not same("a b", "a.b") and not same("x x x", "y y y")
    h, off = quality.words(["go go go", "", None, "!! !!", "go"])
    assert off.tolist() == [0, 3, 3, 3, 5, 6] and h[1] == h[2] == h[4] and h[0] == h[5] != h[1]
    texts = ["one two one two", "", "abc " * 5000]
    bucket, value, at = quality.features(texts)
    assert at.tolist()[:3] == [0, 4, 4] and np.allclose([(value[a:b] ** 2).sum() for a, b in zip(at[:-1], at[1:], strict=True)], [1, 0, 1])


def test_ftrl_like_plain_loops():
    """Sparse updates of numpy against the textbook's loop over coordinates."""
    r = random.Random(4)
    m, z, n, bias = quality.Ftrl(), {}, {}, [0.0, 0.0]
    w = lambda i: 0.0 if abs(z.get(i, 0)) <= quality.L1 else (np.sign(z[i]) * quality.L1 - z[i]) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2)
    for _ in range(200):
        bucket = np.array(sorted(r.sample(range(30), 6)))
        value, y = np.array([r.random() for _ in bucket]), float(bucket[0] % 2)
        b = -bias[0] / ((quality.BETA + bias[1] ** 0.5) / quality.ALPHA)
        g = 1 / (1 + np.exp(-(b + sum(w(i) * v for i, v in zip(bucket, value, strict=True))))) - y
        old = [w(i) for i in bucket]
        for i, v, o in zip(bucket, value, old, strict=True):
            s = ((n.get(i, 0) + (g * v) ** 2) ** 0.5 - n.get(i, 0) ** 0.5) / quality.ALPHA
            z[i], n[i] = z.get(i, 0) + g * v - s * o, n.get(i, 0) + (g * v) ** 2
        bias = [bias[0] + g - ((bias[1] + g * g) ** 0.5 - bias[1] ** 0.5) / quality.ALPHA * b, bias[1] + g * g]
        m.learn(bucket, value, y)
    assert np.allclose([m.weights(np.array([i]))[0] for i in range(30)], [w(i) for i in range(30)])


def test_quality_odd(spark):
    rows = [(1, None, None), (2, "", "en"), (3, " \n\t", "en"), (None, "a b", "en"), (5, "word", "en"), (5, "word", "en"), (7, "é" * 50_000 + " x" * 50_000, "fr"), (8, "1+2 @ <> & + 3", "de")]
    odd, none = docs(spark, rows), docs(spark, [])
    labels = lambda v: spark.createDataFrame(v, "doc_id long, quality int, toxic int, score string")
    some = labels([(1, 0, 0, "x"), (2, 1, 0, "x"), (3, 1, None, "x"), (7, 0, 1, "x"), (7, 1, 1, "x"), (8, 0, 1, "x"), (None, 1, 1, "x"), (5, None, 0, "x")])
    for lab in (some, labels([]), labels([(2, 1, 0, "x")])):
        got = quality.score(odd, quality.fit(quality.labelled(odd, lab))).collect()
        assert len(got) == 8 and all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1
        assert quality.score(none, quality.fit(quality.labelled(none, lab))).count() == 0
    again = [quality.score(odd, quality.fit(quality.labelled(odd.repartition(k), some))).orderBy("doc_id", "score").collect() for k in (1, 5)]
    assert again[0] == again[1]


# ---------------------------------------------------------------- collocations

def brute_phrases(rows, least, longest, top):
    """Counters and Python integers, straight from the rules."""
    f, total = {}, Counter()
    for text, lang in rows:
        lang, text = lang or "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            c = f.setdefault(lang, Counter())
            c.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        drop = {q[i:j] for q, a in cand.items() for i in range(len(q)) for j in range(i + 1, len(q) + 1) if j - i < len(q) and a >= c[q[i:j]]}
        best = []
        for p, a in cand.items():
            if p not in drop:
                s, _, lo, hi = min((1000 * a * total[lang] // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                best.append((-s, -a, " ".join(p).encode(), lo, hi))
        out += [(lang, i + 1, p.decode(), -a, lo, hi, total[lang], -s) for i, (s, a, p, lo, hi) in enumerate(sorted(best)[:top])]
    return sorted(out)


def phrases(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_collocations_match_sql(spark, data):
    big = data.replace("0.001", "0.01")
    assert phrases(QUERIES["op12_collocations"](spark, big)) == sorted(sql(big, "op12_collocations", "documents").fetchall())


@pytest.mark.parametrize("bits", [None, 2])
def test_collocations_like_brute_force(spark, monkeypatch, bits):
    """Also with a sketch so narrow that it lets nearly everything through."""
    if bits:
        monkeypatch.setattr(collocations, "LEAST_BITS", 14)
        monkeypatch.setattr(collocations, "MOST_BITS", 14)
    r = random.Random(8)
    pool = ["New", "new", "york", "Ü", "ü", "a\xa0b", "x-1", "city", "of", "the", "\x0bz", "Ça"]
    rows = [("".join(r.choice(pool) + r.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "; "]) for _ in range(r.randrange(60))), r.choice(["en", "fr", None])) for _ in range(120)]
    rows += [(None, "en"), ("", None), ("the city of new york " * 40, "de"), ("the city of new york " * 40, "de")]
    got = phrases(collocations.collocations(docs(spark, [(i, t, lang) for i, (t, lang) in enumerate(rows)]).repartition(5), least=6, top=25))
    assert got == brute_phrases(rows, 6, 5, 25) and len(got) > 60


def test_collocations_exact_beyond_64_bits(spark):
    """Counts of a corpus too large to make: 1000 a n has more than 64 bits."""
    a, n, lo, hi = 9 * 10**15, 9 * 10**17 - 1, 9 * 10**16 - 7, 9 * 10**15 + 3
    from pyspark.sql import functions as F

    got = spark.range(1).select(F.call_function("div", F.lit(1000).cast("decimal(4,0)") * F.lit(a).cast("decimal(18,0)") * F.lit(n).cast("decimal(18,0)"), F.lit(lo).cast("decimal(18,0)") * F.lit(hi).cast("decimal(18,0)"))).first()[0]
    assert got == 1000 * a * n // (lo * hi)


def test_collocations_word_ids_without_hashes(monkeypatch):
    """Words of one hash are told apart by their bytes."""
    t = collocations.Tokens([("en", "ab cd ab ef cd")])
    assert len(set(t.ids())) == 3 and t.ids()[0] == t.ids()[2]
    t.hash[:] = t.hash[0]
    assert len(set(t.ids())) == 3 and t.ids()[0] == t.ids()[2]


def test_sketch_blocks_packed():
    r = np.random.default_rng(1)
    for share, kind in ((0.001, np.uint8), (0.3, np.uint8), (1.0, np.uint16)):
        block = np.where(r.random(collocations.BLOCK) < share, r.integers(1, 255, collocations.BLOCK), 0).astype(kind)
        block[[0, -1]] = 7
        at, n = collocations.unpacked(collocations.packed(block), kind)
        again = np.zeros_like(block)
        again[at] = n
        assert np.array_equal(again, block)


def test_collocations_odd(spark):
    assert phrases(collocations.collocations(docs(spark, []))) == []
    assert phrases(collocations.collocations(docs(spark, [(1, None, None), (2, " . ", "en"), (3, "one two", "en")]))) == []
    long = "ab cd " * 200_000
    got = phrases(collocations.collocations(docs(spark, [(1, long, "en"), (None, long, "en"), (None, long, "en")])))
    assert [g[2] for g in got if g[3] == 600_000] == ["ab cd"] and {g[6] for g in got} == {1_200_000}


# ---------------------------------------------------------------- conversations

def brute_repair(rows):
    """Dijkstra over (rows read, state) with the audit as tie-break, straight from the rules.  rows: (role, text) in order."""
    seen, code = set(), []
    for role, text in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        code.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {("z", "s"): "s", ("z", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "z", ())], set()
    while heap:
        cost, audit, i, state, kept = heapq.heappop(heap)
        if i == len(rows) and state in "za":
            return cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest(), Counter(code)
        if (i, state) in done:
            continue
        done.add((i, state))
        for role in ("user", "assistant"):
            if to := step.get((state, role[0])):
                heapq.heappush(heap, (cost + 5, audit + "I", i, to, (*kept, f"{role}:")))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, kept))
            if code[i] in ("", "truncated"):
                more = 5 * (code[i] == "truncated")
                if to := step.get((state, role[:1])):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, to, (*kept, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if to := step.get((state, new[0])):
                        heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, to, (*kept, f"{new}:{text}")))


def brute_conversations(rows):
    """rows: (conv_id, turn, role, text) to what the query returns."""
    show = lambda v: " " if v is None else str(v)
    convs = {}
    for conv, turn, role, text in rows:
        own, k = convs.setdefault(conv, []), zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        own += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).digest()))
        turns = [t for t, _, _ in own if t is not None]
        cost, audit, sha, n = brute_repair([x[1:] for x in own])
        pairs = [a[1][:1] + "-" + b[1][:1] for a, b in zip(own[:-1], own[1:], strict=True)]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n["blank"], n["duplicate"], n["truncated"], sum(p not in ("s-u", "u-a", "a-u") for p in pairs), cost, audit, sha))
    return sorted(out, key=str)


def repaired(spark, monkeypatch, rows):
    d = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], CONV)
    monkeypatch.setattr(conversations, "table", lambda *a: d)
    return sorted((tuple(r) for r in conversations.op13_conversations(spark, "").collect()), key=str)


def test_conversations_match_sql(spark, data):
    for folder in (data, data.replace("0.001", "0.01")):
        got = QUERIES["op13_conversations"](spark, folder)
        want = sql(folder, "op13_conversations", "conversations")
        assert [c for c, _ in got.dtypes] == want.columns
        assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())


def test_layers_like_dijkstra():
    """Costs and least audits of short, long and very faulty conversations."""
    r = random.Random(6)
    for trial in range(400):
        n = r.choice([0, 1, 2, 3, 5, 8, 20, 64, 65, 130, 200])
        weights = r.choice([(8, 1, 1), (1, 1, 1), (0, 1, 3)])
        rows = []
        for i in range(n):
            role = r.choice([["user", "assistant"][i % 2], r.choice(["user", "assistant", "system", " ", "", "tool", "sue"])])
            text = r.choices([f"{i} fine.", "", f"{i} cut"], weights)[0]
            rows.append(rows[-1] if rows and r.random() < 0.05 else (role, text))
        seen, codes = set(), bytearray()
        for role, text in rows:
            fault = conversations.BLANK if not text else conversations.DUPLICATE if (role, text) in seen else conversations.CUT if text[-1] != "." else conversations.FINE
            seen.add((role, text))
            codes.append(fault * 4 + ({"s": 1, "u": 2, "a": 3}.get(role[:1], 0)))
        assert conversations.cheapest(bytes(codes)) == brute_repair(rows)[:2], (trial, rows)


def test_conversations_like_brute_force(spark, monkeypatch):
    r = random.Random(9)
    rows = []
    for conv in [*range(40), None]:
        for turn in range(r.choice([1, 2, 7, 150])):
            role = r.choice(["system"] * (turn == 0) + ["user", "assistant"][turn % 2 :] + [r.choice(["user", "tool", "", None, "Assistant"])])
            rows.append((conv, r.choice([turn, turn, turn, turn + 1, None]) if r.random() < 0.2 else turn, role, r.choice([f"t{turn}.", f"t{turn} é! \n", "same.", " \t", None, "open"])))
    assert repaired(spark, monkeypatch, rows) == brute_conversations(rows)


def test_conversations_odd(spark, monkeypatch):
    assert repaired(spark, monkeypatch, []) == []
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "Gone."), (-1, None, None, None), (-2, 5, "user", "x" * 300_000 + "."), (-2, 6, "assistant", "y" * 300_000 + ".")]
    got = repaired(spark, monkeypatch, rows)
    assert got == brute_conversations(rows)
    assert next(g for g in got if g[0] == dropped) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    one = [(7, i, "user", "again.") for i in range(5000)]  # one conversation of one text
    assert repaired(spark, monkeypatch, one) == brute_conversations(one)


def test_repaired_rows(spark):
    """The operator's own output: the rows themselves."""
    rows = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Well."), (1, 2, "user", "Bye."), (2, 0, "user", "")], "conv_id long, turn long, role string, text string")
    found = conversations.audits(rows)
    got = conversations.repaired(rows, found).orderBy("conv_id", "place").collect()
    assert [tuple(r) for r in got] == [(1, 0, "K", "user", "Well."), (1, 1, "R", "assistant", "Bye.")]
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in found.collect()} == {1: (3, "DKR"), 2: (2, "D")}
