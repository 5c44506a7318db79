"""Sharding (operator 3): a Feistel permutation of global row numbers. DataFrame functions only.

Every row gets a number from 0 to N-1 without a global sort: rows fall into a fixed number of buckets by a hash of
their content, are ordered inside a bucket, and an exclusive running total over the bucket sizes (a table of at most
``BUCKETS`` rows) gives each bucket its first number. The number is a function of the rows' content alone, not of
files, partitions or retries. A keyed Feistel network over the grid ``a x b`` (the smallest near-square grid with at
least N cells) permutes it; numbers outside 0..N-1 walk the cycle until they are inside. From the permuted number p,
shard = p mod shards and slot = p div shards: both can be computed for any row number, and shard sizes differ by one
at most (law ``rows``; keeping equal texts together is no part of this law).

Equal rows are counted before the shuffle and spread again after it, so many copies of one row make no hot bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.llm.common import let

BUCKETS = 1024
ROUNDS = 6
#: Steps of a cycle walk in one expression. The grid has under sqrt(N)+1 cells too many, so a step fails with a
#: chance below 1/sqrt(N), and a walk is never longer than that surplus; a longer one raises an error.
WALK = 64
#: Copies that one generator row spreads.
SPREAD = 4096


def feistel(x: Column, n: int, seed: int) -> Column:
    """A bijection of 0..n-1 for ``x`` in that range, keyed by ``seed``."""
    if n <= 1:
        return F.lit(0).cast("long")
    a = max(1, math.isqrt(n - 1) + 1)
    b = -(-n // a)

    def once(v: Column) -> Column:
        # Alternating rounds on (left in Z_a, right in Z_b): each adds a keyed hash of the other half.
        left, right = F.floor(v / F.lit(b)), F.pmod(v, F.lit(b))
        state = F.struct(left.alias("l"), right.alias("r"))
        keyed = lambda r, half, size: F.pmod(F.xxhash64(F.lit(seed * 1000 + r), half), F.lit(size))
        on_left = lambda r: lambda s: F.struct(F.pmod(s["l"] + keyed(r, s["r"], a), F.lit(a)).alias("l"), s["r"].alias("r"))
        on_right = lambda r: lambda s: F.struct(s["l"].alias("l"), F.pmod(s["r"] + keyed(r, s["l"], b), F.lit(b)).alias("r"))
        for r in range(ROUNDS):
            state = let(state, on_right(r) if r % 2 else on_left(r))
        return let(state, lambda s: s["l"] * F.lit(b) + s["r"])

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.lit(-1).cast("long"), lambda acc, i: F.when(acc.between(0, n - 1), acc).otherwise(once(F.when(acc < 0, x).otherwise(acc))))
    return let(walked, lambda w: F.when(w.between(0, n - 1), w).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long")))


def shuffle_rows(rows: DataFrame, shards: int, seed: int = 17) -> DataFrame:
    """``rows`` with ``row_number``, ``position`` (the permuted number), ``shard`` and ``slot``.

    Nulls take part in order and hash like any value; equal rows are interchangeable and each gets a place of its
    own; an empty table gives an empty result. Columns of ``rows`` keep their names; a clashing one of the four
    result names is replaced. All columns must be orderable (no maps).
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    names = [c for c in rows.columns if c not in ("row_number", "position", "shard", "slot")]
    at, of = [f"_{i}" for i in range(len(names))], range(len(names))
    plain = rows.select(*[F.col(f"`{n}`").alias(a) for n, a in zip(names, at, strict=True)])
    counted = plain.withColumn("h", F.xxhash64(*at)).groupBy(F.pmod("h", F.lit(BUCKETS)).alias("bucket"), "h", *at).agg(F.count("*").alias("n"))
    sizes = counted.groupBy("bucket").agg(F.sum("n").alias("rows"))
    total = sizes.agg(F.sum("rows")).first()[0] or 0
    # At most BUCKETS rows: a window without partitions and a broadcast are safe at any input size.
    first = sizes.select("bucket", (F.sum("rows").over(Window.orderBy("bucket")) - F.col("rows")).alias("base"))
    inside = Window.partitionBy("bucket").orderBy("h", *at).rowsBetween(Window.unboundedPreceding, -1)
    numbered = counted.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(first), "bucket")
    spread = numbered.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {SPREAD}"))))
    spread = spread.withColumn("copy", F.explode(F.sequence(F.col("block") * SPREAD, F.least(F.col("n"), (F.col("block") + 1) * SPREAD) - 1)))
    placed = spread.withColumn("row_number", F.col("base") + F.col("before") + F.col("copy")).withColumn("position", feistel(F.col("row_number"), total, seed))
    return placed.select(*[F.col(at[i]).alias(names[i]) for i in of], "row_number", "position", F.pmod("position", F.lit(shards)).cast("int").alias("shard"), F.expr(f"position div {shards}").alias("slot"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` into 24 shards by law ``rows``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shuffle_rows(slim, 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number", "position")


QUERIES = {"op3_sharding": op3_sharding}
