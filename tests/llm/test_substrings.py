import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.llm import substrings as B


def brute(rows, length):
    first = {}
    texts = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in texts:
        if d is not None:
            for i in range(len(w) - length + 1):
                k = tuple(w[i : i + length])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if d is not None and first[tuple(w[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize(("length", "seed"), [(13, 4), (13, 6), (5, 2), (50, 16)])
def test_against_brute_force(few, rows, length, seed):
    got = sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)) for r in B.dedup_substrings(few, length, seed, digest=True).collect())
    assert got == brute([(r[0], r[1]) for r in rows], length)


def test_hot_passage_and_kept_text(spark, few):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"start{i}  own{i}\twords{i} {passage}\nlast{i}") for i in range(300)], "doc_id long, text string").repartition(7)
    out = {r.doc_id: r for r in B.dedup_substrings(docs, 50, 16, carry=()).collect()}
    assert out[0].n_removed == 0 and out[0].kept_text.count(" p") == 60
    assert all(out[i].n_removed == 60 and out[i].kept_text == f"start{i}  own{i}\twords{i} last{i}" for i in range(1, 300))
    assert [tuple(s) for s in out[5].spans] == [(3, 63)]


def test_carry_and_empty(few, none):
    out = B.dedup_substrings(few.withColumn("spans", F.lit(1)), carry=("lang", "source"))
    assert {"lang", "source"} <= set(out.columns) and out.count() == few.count()
    assert B.dedup_substrings(none).count() == 0
    with pytest.raises(ValueError):
        B.repeats(few, 100, 10)


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 50, 400).astype(np.uint64)
    words[300:340] = words[100:140]
    at, _, place, _ = B.anchors(words, np.array([0, 400]), 13, 4)
    assert (place[at == 305] - 305 == place[at == 105] - 105).all()
    h = B.window_hash(words, 13)
    assert (h[300:328] == h[100:128]).all() and len(np.unique(h)) < len(h)


def test_hot_anchor_is_spread_by_window(spark, monkeypatch):
    monkeypatch.setattr(B, "ONE_IN", 4)
    line = "all rights reserved by the owners of this page since two thousand"
    rows = [(i, f"{' '.join(f'a{i}x{j}' for j in range(12))} {line} {' '.join(f'b{i // 2}y{j}' for j in range(12))}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    slim = B.keyed(docs)
    hot = B.hot_anchors(slim, 13, 4)
    most = lambda df: df.filter("tell is not null").groupBy("anchor").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert len(hot) and most(B.sent(slim, 13, 4)) > 250 and most(B.sent(slim, 13, 4, hot)) < 120
    got = sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)) for r in B.dedup_substrings(docs, digest=True).collect())
    assert got == brute(rows, 13)
