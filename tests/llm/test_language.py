import math
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from causeway.llm import language as L


def naive_cost(words, text_words, order):
    """PPM by its definition, in plain Python, for one language."""
    counts = defaultdict(Counter)
    for w in words:
        s = b" " + w + b" "
        for i in range(1, len(s)):
            for o in range(min(order, i) + 1):
                counts[s[i - o : i]][s[i]] += 1
    bits = 0.0
    for w in text_words:
        s = b" " + w + b" "
        for i in range(1, len(s)):
            for o in range(min(order, i), -1, -1):
                c = counts.get(s[i - o : i])
                if not c:
                    continue
                total = sum(c.values()) + len(c)
                if s[i] in c:
                    bits -= math.log2(c[s[i]] / total)
                    break
                bits -= math.log2(len(c) / total)
            else:
                bits += 8
    return bits


def test_code_lengths(spark):
    train = [("the cat sat on the mat, the end", "a"), ("der hund und die katze", "b"), ("the other cat", "a")]
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(train)], "doc_id long, text string, lang string")
    trees = L.fit(docs, order=3)
    text = "the dog sat under zebra é katze " + "thecatsatonthemat" * 40
    got, size = trees.texts([text.encode(), None])
    for k, x in enumerate(trees.languages):
        own = [w for t, y in train if y == x for w in t.encode().split()]
        assert math.isclose(got[0, k], naive_cost(own, text.encode().split(), 3), rel_tol=1e-4)
    assert got[1].tolist() == [0, 0] and size.tolist() == [len(text.encode()) + 1, 0]


def test_held_out_accuracy(spark, sf):
    out = L.op4_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null")
    n, right = out.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 200 and right / n > 0.98


def test_edges(spark, few, rows, none):
    trees = L.fit(few)
    out = L.identify(few.withColumn("score", F.lit("clash")), trees).collect()
    assert len(out) == len(rows)
    for r in out:
        has = r.text is not None and any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und") == (not has) and 0 <= r.score <= 1
    assert L.identify(none, trees).count() == 0
    assert {r.lang_pred for r in L.identify(few, L.fit(none)).collect()} == {"und"}


def test_many_languages(spark):
    docs = spark.createDataFrame([(i, f"word{i} only{i} of{i}", f"l{i:04}") for i in range(1000)], "doc_id long, text string, lang string")
    out = L.identify(docs, L.fit(docs)).collect()
    assert sum(r.lang_pred == r.lang for r in out) > 990


def test_table():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    t = L.Table(keys)
    assert (t.find(keys) == np.arange(len(keys))).all() and (t.find(keys + np.uint64(1)) == -1).all()


def peak(run):
    """MB that ``run`` takes at most, besides what was there."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_memory_of_tasks(spark, monkeypatch):
    tasks, giving_back = [], L.giving_back
    monkeypatch.setattr(L, "giving_back", lambda run: tasks.append(run) or giving_back(run))
    trees = L.fit(spark.createDataFrame([(1, "some words to learn from", "a"), (2, "andere worte zum lernen", "b")], "doc_id long, text string, lang string"))
    text = " ".join(f"w{i % 5000:x} the" for i in range(5_000))
    batch = pa.RecordBatch.from_arrays([pa.array([text] * 80), pa.array(["a"] * 80)], names=["text", "lang"])  # 3.6 MB of one language
    assert peak(lambda: list(tasks[0]([batch]))) < 40
    assert peak(lambda: list(tasks[0]([pa.RecordBatch.from_arrays([pa.array([text * 80]), pa.array(["a"])], names=["text", "lang"])]))) < 40
    lone = [" ".join(f"w{i * 7919 % 1_000_003:x}" for i in range(k, k + 500)).encode() for k in range(0, 400_000, 500)]  # no word twice
    assert peak(lambda: trees.texts(lone)) < 110


def test_parts_of_long_texts(spark, monkeypatch):
    trees = L.fit(spark.createDataFrame([(1, "some words to learn from", "a"), (2, "andere worte zum lernen", "b")], "doc_id long, text string, lang string"))
    texts = [b"some\x0bwords  to " * 50, None, b"", b" \t ", b"andere " + b"x" * 300 + b" worte\n"]
    whole = trees.texts(texts)
    counts = L.context_counts(texts, 3)
    monkeypatch.setattr(L, "CHUNK_BYTES", 17)
    monkeypatch.setattr(L, "AT_ONCE", 10)
    trees.fresh()
    cut = trees.texts(texts)
    assert np.allclose(whole[0], cut[0]) and whole[1].tolist() == cut[1].tolist() == [len(b"".join(t.split())) + len(t.split()) if t else 0 for t in texts]
    for limit in (1, 17, 1000):
        for a, b in zip(counts, L.context_counts(texts, 3, limit)):
            assert a.tolist() == b.tolist()
    column = pa.array([t and t.decode() for t in texts])
    for limit in (1, 400, 10_000):
        assert [x for piece in L.slices(column, limit) for x in piece.to_pylist()] == column.to_pylist()
