"""Document fingerprints (operator 10): order MinHash. DataFrame functions only.

Words ``k`` at a time are a text's k-mers (a shorter text is one k-mer); the j-th occurrence of a k-mer in the text is
an item of its own. The ``SKETCH`` items with the smallest hashes are retained. Each two that are neighbours in hash order
are put in text order and hashed together: the pairs are random in position, so a pair agrees between two texts only if
both items survive and stand in the same order, which follows edit distance rather than set overlap. The signature is
the set of pair hashes; likeness is the share of common pairs in the larger signature.

Everything happens inside one row, so the fingerprint itself shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.llm.common import GAP, let, materialize

K = 3
SKETCH = 48
#: Steps of the search for the first of equal hashes; enough for 2^30 k-mers.
STEPS = 30


def items(text: Column, k: int = K) -> Column:
    """Array of the hashes of occurrence-numbered k-mers in text order; null and blank texts have none."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), GAP, -1), lambda w: w != "")

    def kmers(w: Column) -> Column:
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
        return F.when(n >= k, many).when(n > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))

    def numbered(h: Column) -> Column:
        first = F.transform(h, lambda x: F.xxhash64(x, F.lit(0)))

        def with_repeats(s: Column) -> Column:
            # s: (hash, position) in order. The occurrence number is the distance to the first of the equal hashes,
            # found by doubling steps, so that even one word repeated throughout costs n log n.
            def occurrence(x: Column, i: Column) -> Column:
                same = lambda d: F.when(i >= d, F.get(s, (i - d).cast("int"))["h"] == x["h"]).otherwise(False)
                far = F.aggregate(F.sequence(F.lit(STEPS), F.lit(0), F.lit(-1)), F.lit(0).cast("long"), lambda acc, b: let(acc + F.call_function("shiftleft", F.lit(1).cast("long"), b), lambda d: F.when(same(d), d).otherwise(acc)))
                return F.when(same(F.lit(1)), far).otherwise(F.lit(0).cast("long"))

            g = F.transform(s, lambda x, i: F.struct(x["p"].alias("p"), F.xxhash64(x["h"], occurrence(x, i).cast("int")).alias("g")))
            return F.transform(F.array_sort(g), lambda x: x["g"])

        repeated = let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), with_repeats)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), first).otherwise(repeated)

    return let(let(words, kmers), numbered)


def smallest(g: Column, size: int) -> Column:
    """The ``size`` smallest of ``g`` in order. Only values under a bound that about three times as many stay below are sorted; if too few do, all are."""

    def under(n: Column) -> Column:
        bound = F.lit(-(2.0**63)) + F.lit(2.0**64) * F.lit(3.0 * size) / n
        return let(F.filter(g, lambda x: x.cast("double") <= bound), lambda few: F.when(F.size(few) >= size, few).otherwise(g))

    chosen = F.when(F.size(g) > 3 * size, let(F.size(g), under)).otherwise(g)
    return F.slice(F.sort_array(chosen), 1, size)


def signature(text: Column, k: int = K, size: int = SKETCH) -> Column:
    """Sorted distinct pair hashes of ``text``; one item alone is hashed by itself; no words, no pairs."""

    def pairs(g: Column) -> Column:
        def order(low: Column) -> Column:
            retained = F.filter(g, lambda x: x <= F.element_at(low, -1))  # in text order
            place = F.array_sort(F.transform(retained, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

            def hashed(p: Column) -> Column:
                two = lambda j: let(F.struct(F.get(p, j).alias("a"), F.get(p, j + 1).alias("b")), lambda q: F.when(q["a"]["i"] < q["b"]["i"], F.xxhash64(q["a"]["x"], q["b"]["x"])).otherwise(F.xxhash64(q["b"]["x"], q["a"]["x"])))
                return F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(0), F.size(p) - 2), two)).otherwise(F.transform(p, lambda q: q["x"]))

            return let(place, hashed)

        none = F.array().cast("array<bigint>")
        return F.when(F.size(g) > 0, let(smallest(g, size), order)).otherwise(none)

    return F.sort_array(F.array_distinct(let(items(text, k), pairs)))


def likeness(a: Column, b: Column) -> Column:
    """Common share of the larger signature, 0 to 1; two empty ones are alike."""
    larger = F.greatest(F.size(a), F.size(b))
    return F.when(larger == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / larger)


def printed(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def next_in_order(keys: DataFrame, order: list[str], carry: list[str]) -> DataFrame:
    """Each row of ``keys`` (distinct in ``order``) with ``next_<c>`` for every column c of ``order`` and ``prev_<c>``
    for those in ``order`` + ``carry``; the first row follows the last.

    Spark's range partitioner makes ordered partitions; a window inside each and one over the partitions' ends (a row
    for each partition) join them up.
    """
    spark = keys.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(keys.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranged")
    w = Window.partitionBy("part").orderBy(*order)
    row, head = F.struct(*order), F.struct(*order, *carry)
    inner = ranged.withColumn("n", F.lead(row).over(w)).withColumn("p", F.lag(head).over(w))
    ends = ranged.groupBy("part").agg(F.min(row).alias("lo"), F.max(head).alias("hi"))
    around = Window.orderBy("part")
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lead("lo").over(around), F.first("lo").over(whole)).alias("after"), F.coalesce(F.lag("hi").over(around), F.last("hi").over(whole)).alias("before"))
    out = inner.join(F.broadcast(ends), "part").withColumn("n", F.coalesce("n", "after")).withColumn("p", F.coalesce("p", "before"))
    return out.select(*keys.columns, *[F.col(f"n.{c}").alias(f"next_{c}") for c in order], *[F.col(f"p.{c}").alias(f"prev_{c}") for c in order + carry])


def with_successor(docs: DataFrame) -> DataFrame:
    """(doc_id, text, sig, tail, next_sig) of every row of ``docs`` (doc_id, text; null text: empty).

    ``tail``: the first floor(n_chars/4) code points of the next document by ascending doc_id. Equal rows count as one
    document and share its successor; rows of one doc_id and other texts follow in the order of a hash of the text; a
    null doc_id comes first. The whole texts are shuffled once, by document; of the next one only the needed beginning.
    """
    base = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.select(F.struct(F.isnotnull("doc_id").alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("h")).alias("key"), "text")
    keys = base.groupBy("key").agg(F.max(F.length("text")).alias("need")).withColumn("need", F.floor(F.col("need") / 4).cast("int"))
    chain = next_in_order(keys, ["key"], ["need"])
    # Both uses of ``rows`` below need the same columns, so that Spark shuffles the texts once and reuses the exchange.
    rows = base.withColumn("sig", signature(F.col("text")))
    heads = rows.join(chain.select("key", "prev_key", "prev_need"), "key")
    heads = heads.select(F.col("prev_key").alias("key"), F.expr("substring(text, 1, prev_need)").alias("tail"), F.col("sig").alias("next_sig"))
    return rows.join(heads.dropDuplicates(["key"]), "key", "left").withColumn("doc_id", F.when(F.col("key.known"), F.col("key.id")))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text of ``documents`` and of its edited text."""
    both = with_successor(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    n = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))"), F.coalesce("tail", F.lit("")))
    out = both.select("doc_id", n.cast("long").alias("n_chars"), "sig", "next_sig", edited.alias("edited"))
    made = let(F.struct(F.col("sig").alias("a"), signature(F.col("edited")).alias("e"), F.col("next_sig").alias("x")), lambda s: F.struct(
        printed(s["a"]).alias("fingerprint"), printed(s["e"]).alias("edited_fingerprint"), likeness(s["a"], s["e"]).alias("near_edited"), likeness(s["a"], s["x"]).alias("near_next")))
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), F.inline(F.array(made)))


QUERIES = {"op10_document_fingerprints": op10_document_fingerprints}
