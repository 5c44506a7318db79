from collections import Counter

import xxhash
from pyspark.sql import functions as F

from causeway.llm import sharding as H


def spark_hash(key: int, x: int) -> int:
    first = xxhash.xxh64_intdigest((key & 0xFFFFFFFF).to_bytes(4, "little"), seed=42)
    h = xxhash.xxh64_intdigest((x & (2**64 - 1)).to_bytes(8, "little"), seed=first)
    return h - 2**64 if h >= 2**63 else h


def feistel(x, n, seed):
    if n <= 1:
        return 0
    a = int((n - 1) ** 0.5) + 1
    while (a - 1) ** 2 > n - 1:
        a -= 1
    b = -(-n // a)
    while True:
        left, right = divmod(x, b)
        for r in range(H.ROUNDS):
            if r % 2:
                right = (right + spark_hash(seed * 1000 + r, left) % b) % b
            else:
                left = (left + spark_hash(seed * 1000 + r, right) % a) % a
        x = left * b + right
        if x < n:
            return x


def test_feistel_is_a_permutation(spark):
    for n in (1, 2, 3, 5, 97, 1000):
        got = [r[0] for r in spark.range(n).select(H.feistel(F.col("id"), n, 17)).collect()]
        assert sorted(got) == list(range(n))
        assert got == [feistel(i, n, 17) for i in range(n)]


def test_shards(spark, few, rows):
    slim = few.select("doc_id", F.length("text").alias("size"))
    out = H.shuffle_rows(slim, 7).collect()
    assert sorted(r.row_number for r in out) == list(range(len(rows)))
    assert Counter((r.doc_id, r.size) for r in out) == Counter((r[0], None if r[1] is None else len(r[1])) for r in rows)
    for r in out:
        assert (r.shard, r.slot) == (r.position % 7, r.position // 7) and r.position == feistel(r.row_number, len(rows), 17)
    again = H.shuffle_rows(slim.repartition(9), 7).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_many_copies_and_clashing_names(spark, none):
    df = spark.range(20_000).select(F.lit(5).alias("shard"), F.lit("x").alias("slot.x"), (F.col("id") % 3).alias("b"))
    out = H.shuffle_rows(df, 4)
    assert out.columns.count("shard") == 1 and out.count() == 20_000
    assert {r["count"] for r in out.groupBy("shard").count().collect()} == {5000}
    assert H.shuffle_rows(none, 4).count() == 0
