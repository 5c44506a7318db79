import hashlib
from collections import defaultdict
from struct import pack

import pytest
import xxhash
from pyspark.sql import functions as F

from causeway.llm import fingerprints as O


@pytest.fixture(scope="module")
def out(spark, sf):
    return {r.doc_id: r for r in O.op10_document_fingerprints(spark, sf).collect()}


def test_edited_texts_and_likeness(spark, sf, out):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    assert len(out) == len(docs)
    equal = defaultdict(set)
    for i, (d, t) in enumerate(docs):
        n = len(t) // 4
        edited = t[: len(t) - n] + docs[(i + 1) % len(docs)][1][:n]
        assert out[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and out[d].n_chars == len(t)
        equal[t].add(out[d].fingerprint)
    assert all(len(v) == 1 for v in equal.values()) and len({f for v in equal.values() for f in v}) > 0.95 * len(equal)
    near = [out[d].near_edited for d, t in docs if len(t) > 200]
    assert sum(near) / len(near) > 0.35 and sum(r.near_next for r in out.values()) / len(out) < 0.05


def naive_items(words, hashes, k):
    seen = defaultdict(int)
    out = []
    for x in hashes:
        out.append((x, seen[x]))
        seen[x] += 1
    return out


def test_occurrence_numbers(spark):
    texts = ["a b c a b c a b c", "x " * 500, "p q r s t", "one", "", None, "u v w " * 30 + "u v"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    h = F.transform(F.filter(F.split(F.coalesce("t", F.lit("")), O.GAP), lambda w: w != ""), lambda w: w)
    rows = df.withColumn("w", h).select("i", "w", O.items(F.col("t")).alias("g")).collect()
    for r in rows:
        w = r.w
        k = [tuple(w[j : j + O.K]) for j in range(len(w) - O.K + 1)] if len(w) >= O.K else [tuple(w)] if w else []
        numbered = naive_items(w, k, O.K)
        assert len(r.g) == len(k) and len(set(r.g)) == len(set(numbered))
        pairs = dict(zip(r.g, numbered, strict=True))
        assert all(pairs[g] == n for g, n in zip(r.g, numbered, strict=True))


def hashed(*parts):
    """What Spark's xxhash64 makes of columns: each is hashed with the hash of those before it as seed."""
    seed = 42
    for x in parts:
        seed = xxhash.xxh64_intdigest(x, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def naive_signature(text):
    words = (text or "").encode().split()
    kmers = [hashed(*words[i : i + O.K]) for i in range(len(words) - O.K + 1)] if len(words) >= O.K else [hashed(b" ".join(words))] if words else []
    numbered = [hashed(pack("<q", x), pack("<i", j)) for x, j in naive_items(words, kmers, O.K)]
    chosen = sorted(sorted((g, i) for i, g in enumerate(numbered))[: O.SKETCH])
    if len(chosen) < 2:
        return sorted(g for g, _ in chosen)
    pairs = zip(chosen, chosen[1:], strict=False)
    return sorted({hashed(*[pack("<q", g) for g, _ in sorted(two, key=lambda x: x[1])]) for two in pairs})


def naive_likeness(a, b):
    return len(set(a) & set(b)) / max(len(a), len(b)) if a or b else 1.0


def test_query_against_brute_force(spark, sf, out):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    printed = lambda s: "".join(f"{x % (1 << 64):016x}" for x in s)
    for i, (d, t) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        n = len(t) // 4
        own, edited, other = (naive_signature(x) for x in (t, t[: len(t) - n] + after[:n], after))
        r = out[d]
        assert (r.fingerprint, r.edited_fingerprint) == (printed(own), printed(edited))
        assert (r.near_edited, r.near_next) == pytest.approx((naive_likeness(own, edited), naive_likeness(own, other)))


def test_order_matters(spark):
    words = [f"w{i}" for i in range(400)]
    half = " ".join(words[200:] + words[:200])
    df = spark.createDataFrame([(" ".join(words), half)], "a string, b string")
    moved = df.select(O.likeness(O.signature(F.col("a")), O.signature(F.col("b")))).first()[0]
    assert 0.2 < moved < 0.8


def test_smallest_is_exact(spark):
    df = spark.range(50).select("id", F.transform(F.sequence(F.lit(1), F.lit(20) * (F.col("id").cast("int") + 1)), lambda i: F.xxhash64(i, F.lit(3))).alias("g"))
    for r in df.select("g", O.smallest(F.col("g"), 48).alias("s")).collect():
        assert r.s == sorted(r.g)[:48]


def test_odd_rows(spark, few, rows, none):
    got = O.with_successor(few.select("doc_id", "text"))
    assert got.count() == len(rows) and got.filter("tail is null").count() == 0
    assert O.with_successor(none.select("doc_id", "text")).count() == 0
    one = O.with_successor(spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")).first()
    assert one.tail == "a b"


def test_no_python(spark, few):
    assert "Python" not in O.with_successor(few)._jdf.queryExecution().executedPlan().toString()
