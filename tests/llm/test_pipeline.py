"""The pipeline's stages against plain versions of what each decides."""

import zlib

import corpus_pipeline
import duckdb
import numpy as np

from tagcall.llm import token_store
from tagcall.llm._spark import saved, table


def test_stages(spark, data):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_dedup", "decontaminate", "mix", "tokens"]
    docs = first = table(spark, data, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, data), f"test-{name}")
        kept[name] = docs
        if name != "tokens":
            assert docs.columns == first.columns
    ids = {n: sorted(r[0] for r in d.select("doc_id").collect()) for n, d in kept.items()}
    bench = [" " + " ".join(t.lower().split()) + " " for (t,) in duckdb.sql(f"SELECT text FROM '{data}/benchmark.parquet'").fetchall()]
    held = {r["doc_id"]: " " + " ".join(r["text"].lower().split()) + " " for r in kept["near_dedup"].select("doc_id", "text").collect()}
    leaks = {i for i, t in held.items() if any(b in t for b in bench)}
    assert leaks and not leaks & set(ids["decontaminate"])
    assert len(ids["decontaminate"]) >= len(held) - 1.3 * len(leaks) - 1
    assert set(ids["mix"]) <= set(ids["decontaminate"]) and ids["tokens"] == ids["mix"]
    w = token_store.WordTokenizer(token_store.tokenizer_path())
    start = 0
    texts = {r["doc_id"]: r["text"] for r in kept["mix"].select("doc_id", "text").collect()}
    for r in sorted(kept["tokens"].collect(), key=lambda r: r["start"]):
        tokens, _ = w.encode_many([texts[r["doc_id"]]])
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(tokens), zlib.crc32(np.asarray(tokens, "<u4").tobytes()))
        start += len(tokens)


def test_odd_documents(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing names and an empty benchmark: only rows without a language go."""
    names = "doc_id long, text string, lang string, source string, n_chars long, hit_id string, fp string, label string, row string, of_id string"
    plain = [("the small house stands near the river and the old mill", "en"), ("la petite maison est pres de la riviere et du moulin", "fr")]
    rows = [(i, plain[i % 2][0] + f" number{i} word{i * 7} thing{i * 13}", plain[i % 2][1], "a") for i in range(1, 13)]
    rows += [(20, None, None, None), (21, "", "en", None), (22, " \t\n", "en", "b"), (23, "1 2 3", "en", "b"), (None, "the mill without an id", None, "b"), (24, "river " * 20000, "en", "b")]
    rows += [(25, "the same row stands twice in the table", "en", "b")] * 2
    folder = str(tmp_path / "odd")
    spark.createDataFrame([(*r, len(r[1] or ""), *"abcde") for r in rows], names).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = table(spark, folder, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = kept[name] = saved(stage(spark, docs, folder), f"odd-{name}")
        if name != "tokens":
            assert docs.columns == [c.split()[0] for c in names.split(", ")]
    ids = {n: sorted(r["doc_id"] or -1 for r in d.select("doc_id").collect()) for n, d in kept.items()}
    assert ids["language"] == [-1, *range(1, 13), 24, 25, 25]
    assert ids["near_dedup"] == ids["decontaminate"] and 25 in ids["near_dedup"] and ids["near_dedup"].count(25) == 1
    assert ids["tokens"] == ids["mix"] and set(ids["mix"]) <= set(ids["decontaminate"])


def test_empty_documents(spark, data, tmp_path):
    folder = str(tmp_path / "none")
    table(spark, data, "documents").limit(0).write.parquet(f"{folder}/documents.parquet")
    table(spark, data, "benchmark").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
