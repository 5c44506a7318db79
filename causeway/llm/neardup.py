"""MinHash near-duplicates (operator 6): bottom-k sketches from one hash function.

1. A task per partition reads whole texts and gives each document the size of its shingle set, a 128-bit hash of the
   set, and the ``SKETCH`` smallest shingle hashes. Documents with equal sets form a class, and only one representative
   goes on: groups of exact copies cost nothing more.
2. Inverted lists: each two neighbours in a class's sketch make a retained value. Two sets of similarity 0.8 share about
   64 % of these values or more (sets no larger than a sketch share one at least, by the pigeonhole principle); a pair
   must share ``needed`` of them. By the prefix principle only the values beyond a class's ``needed - 1`` most frequent
   ones are listed, so very common values are in no list.
3. Pivots: in each list, all members meet one pivot. The sketch of the union estimates the similarity and drops hopeless
   pairs; the others are confirmed on the full shingle sets of the texts. Members that are close to one pivot are compared
   by their differences from it (``by_differences``), which rules out nearly all pairs of a large group of near copies at
   once. Members similar to the pivot are then done with the list: by the triangle inequality of the Jaccard distance
   (1 - 0.8 twice) whatever is similar to them has 0.6 with the pivot, so it was close and has been compared. There are no
   more pairs than list entries.
4. The rest, whose lists still hold members that no pivot settled, meets once in an exact join on prefixes of the full
   sets in order of rarity (``by_prefixes``), with positional filters: chance company in a list of a common value leaves
   no pair behind. No list is cut short and no pair is left out.
5. Components come from alternating large-star and small-star steps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from causeway.llm.common import as_bytes, chunks, giving_back, hashed_words, materialize, mix, rolled, word_hash

SKETCH = 48
#: Share of a union that must be common, in percent.
PERCENT = 80
#: Similarity that whatever is similar to a pivot's partner has with the pivot, in percent.
CLOSE = 60
#: Shares of the union's sketch below which a pair is hopeless: at the threshold, and for the company of a pivot. Both are
#: over five standard deviations below what they stand for.
HOPE, CLOSE_HOPE = 0.45, 0.24
#: Rows up to which ids are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Bytes of text whose shingle sets a task keeps while it compares pairs.
KEPT_BYTES = 2_000_000


def small(ids: DataFrame) -> DataFrame:
    """``ids`` for a broadcast join if they are few; else as they are, for a shuffle join."""
    return F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids


def profiles(docs: DataFrame, k: int, sketch: int) -> DataFrame:
    """doc_id, th (a hash of the text), n (shingles), a, b (hash of the set), low (sketch in order)."""
    schema = "doc_id long, th long, n long, a long, b long, low array<long>"

    def run(batches):
        for batch in batches:
            docs_, ths, texts = batch.column(0), batch.column(1), as_bytes(batch.column(2))
            n, a, b, low = [], [], [], []
            for lo, hi in chunks(texts):
                words, starts = hashed_words(texts[lo:hi], lower=True)
                shingles = rolled(words, k).view(np.int64)
                for i in range(hi - lo):
                    s, e = int(starts[i]), int(starts[i + 1])
                    own = np.unique(shingles[s : e - k + 1] if e - s >= k else rolled(words[s:e], e - s).view(np.int64) if e > s else shingles[:0])
                    mixed = mix(own.view(np.uint64))
                    n.append(len(own))
                    a.append(mixed.sum(dtype=np.uint64).view(np.int64))
                    b.append(np.bitwise_xor.reduce(mix(mixed + np.uint64(7))).view(np.int64) if len(own) else 0)
                    low.append(own[:sketch])
            columns = [docs_, ths, pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(low, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "n", "a", "b", "low"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), F.col("text").cast("string")).mapInArrow(giving_back(run), schema)


def needed(values: Column) -> Column:
    """Values that a pair must share, of ``values``: 1 up to 21, then rising to 7 of 47."""
    return F.greatest(F.lit(1), F.floor((values - 12) / 5))


def inverted_lists(classes: DataFrame) -> DataFrame:
    """(value, cls) of every class (cls, low), without values that occur once and without the most frequent of each class."""
    pairs = F.when(F.size("low") > 1, F.transform(F.sequence(F.lit(0), F.size("low") - 2), lambda i: F.xxhash64(F.get("low", i), F.get("low", i + 1)))).otherwise(F.transform("low", lambda x: F.xxhash64(x)))
    values = classes.select("cls", F.greatest(F.size("low") - 1, F.lit(1)).alias("values"), F.explode(pairs).alias("value"))
    often = values.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    shared = values.join(often, "value")
    place = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("df"), "value"))
    return shared.withColumn("place", place).filter(F.col("place") >= needed(F.col("values"))).select("value", "cls")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the smallest node of its component.

    Large-star and small-star steps in turn; each is a grouping and a join, and each pass is written to the shared folder.
    """
    now = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(near.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            roots = now.groupBy("u").agg(F.min("v").alias("root"))
            return roots.select(F.col("u").alias("node"), "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        mark = seen


def shingle_set(text: bytes, k: int) -> set:
    words = text.lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def compared(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """The pairs (u, v) on their full shingle sets: whether they have the similarity (``ok``), the size ``n`` of v's set,
    and, if they are ``CLOSE``, hashes of the shingles that only one of them has (``diff``; else null)."""

    def run(batches):
        sets: dict[bytes, set] = {}
        held = 0

        def known(t: bytes) -> set:
            nonlocal held
            if t not in sets:
                if held + len(t) > KEPT_BYTES:
                    sets.clear()
                    held = 0
                held += len(t)
                sets[t] = shingle_set(t, k)
            return sets[t]

        for batch in batches:
            ok, n, diff = [], [], []
            for x, y in zip(as_bytes(batch.column(2)), as_bytes(batch.column(3)), strict=True):
                p, q = known(x), known(y)
                common = len(p & q)
                ok.append(100 * common >= PERCENT * (len(p) + len(q) - common))
                n.append(len(q))
                close = 100 * common >= CLOSE * (len(p) + len(q) - common)
                diff.append([word_hash(b" ".join(x)) for x in p ^ q] if close else None)
            made = [pa.array(ok, pa.bool_()), pa.array(n, pa.int64()), pa.array(diff, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["u", "v", "ok", "n", "diff"])

    one = texts.select(F.col("cls").alias("u"), F.col("text").alias("x"))
    two = texts.select(F.col("cls").alias("v"), F.col("text").alias("y"))
    kind = pairs.schema["u"].dataType.simpleString()
    both = pairs.select("u", "v").join(one, "u").join(two, "v").select("u", "v", "x", "y")
    return both.mapInArrow(giving_back(run), f"u {kind}, v {kind}, ok boolean, n long, diff array<long>")


def by_differences(close: DataFrame) -> DataFrame:
    """Pairs (u, v) of the members (cls, n, ok, root, diff) of each pivot that can be similar and have other roots; one of
    them is similar to the pivot (``ok``).

    With a and b the sizes of two members' differences from their pivot and s the sum of their own sizes, similarity
    0.8 means that the differences share (a + b - s / 9) / 2 shingles or more: members that differ from the pivot by edits
    of their own cannot, however many there are. Prefixes of the rarest shingles find the others: a/4 of the set's size
    for the larger difference, 1/8 for the smaller one. Pairs that need no common shingle are both similar to the pivot.
    """
    el = close.select("pivot", "cls", "n", "root", "ok", F.size("diff").alias("a"), F.explode("diff").alias("e"))
    often = el.groupBy("pivot", "e").agg(F.count("*").alias("df")).filter("df > 1")
    w = Window.partitionBy("pivot", "cls")
    shared = el.join(often, ["pivot", "e"]).withColumn("c", F.count("*").over(w))
    ranked = shared.withColumn("r", F.row_number().over(w.orderBy("df", "e")) + F.col("a") - F.col("c"))
    side = lambda x, part: ranked.filter(F.col("r") <= F.floor(F.col("n") / part) + 1).select("pivot", "e", *[F.col(c).alias(f"{x}_{c}") for c in ("cls", "n", "ok", "root", "a", "c", "r")])
    u, v, c = side("u", 4), side("v", 8), F.col
    fits = (c("u_ok") | c("v_ok")) & (c("u_root") != c("v_root")) & ((c("u_a") > c("v_a")) | ((c("u_a") == c("v_a")) & (c("u_cls") > c("v_cls"))))
    twice = 9 * (c("u_a") + c("v_a")) - (c("u_n") + c("v_n"))  # 18 times the shingles that must be shared
    fits &= 18 * F.least("u_c", "v_c") >= twice
    # The rarest shared shingle leaves room for all others behind it.
    fits &= 18 * (1 + F.least(c("u_a") - c("u_r"), c("v_a") - c("v_r"))) >= twice
    fits &= 100 * F.least("u_n", "v_n") >= PERCENT * F.greatest("u_n", "v_n")
    return u.join(v, ["pivot", "e"]).filter(fits).select(F.least("u_cls", "v_cls").alias("u"), F.greatest("u_cls", "v_cls").alias("v")).distinct()


def rooted(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``rows`` (cls, ...) with ``root``; a class without links is its own."""
    if roots is None:
        return rows.withColumn("root", F.col("cls"))
    return rows.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def merged(roots: DataFrame | None, new: DataFrame) -> DataFrame | None:
    """``roots`` after the links ``new`` (u, v): only the graph of known roots is solved."""
    if roots is None:
        return None if new.isEmpty() else materialize(components(new), "roots")
    for end in ("u", "v"):
        new = new.join(roots.select(F.col("node").alias(end), F.col("root").alias("r")), end, "left").withColumn(end, F.coalesce("r", end)).drop("r")
    new = materialize(new.filter("u <> v").select("u", "v").distinct(), "links")
    if new.isEmpty():
        return roots
    top = components(new)
    old = roots.join(top.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return materialize(old.unionByName(top.join(roots.select("node"), "node", "left_anti")), "roots")


def hopeful(pairs: DataFrame, classes: DataFrame, sketch: int, size: int = PERCENT, hope: float = HOPE) -> DataFrame:
    """The pairs that their sizes (the smaller at least ``size`` percent of the larger) and the sketch of their union leave possible."""
    one = classes.select(F.col("cls").alias("u"), F.col("low").alias("p"), F.col("n").alias("np"))
    two = classes.select(F.col("cls").alias("v"), F.col("low").alias("q"), F.col("n").alias("nq"))
    union = F.slice(F.sort_array(F.array_union("p", "q")), 1, sketch)
    both = pairs.join(one, "u").filter("np > 0").join(two, "v").filter(100 * F.least("np", "nq") >= size * F.greatest("np", "nq"))
    both = both.select("u", "v", F.size(F.array_intersect(F.array_intersect("p", "q"), union)).alias("common"), F.size(union).alias("of"))
    return both.filter(F.col("common") >= F.col("of") * hope).select("u", "v")


def shingles(texts: DataFrame, k: int) -> DataFrame:
    """(cls, e): the distinct shingle hashes of each class's text (cls, text)."""
    kind = texts.schema["cls"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            own = [np.fromiter({word_hash(b" ".join(x)) for x in shingle_set(t, k)}, np.int64) for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int64()))], names=["cls", "e"])

    return texts.select("cls", "text").mapInArrow(giving_back(run), f"cls {kind}, e array<long>").select("cls", F.explode("e").alias("e"))


def by_prefixes(el: DataFrame) -> DataFrame:
    """Pairs (u, v) of classes with other roots that can be similar, of ``el`` (cls, n, root, e: all elements of the sets).

    Similar sets share 4/9 of their sizes' sum: of the larger one all but a fifth, of the smaller one all but a ninth. So
    their first common element in order of rarity is among the first fifth, and ninth, of the elements, and leaves room
    for all others behind it. Elements that occur under one root only cannot be shared: they come first and meet nobody.
    """
    often = el.groupBy("e").agg(F.count("*").alias("df"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("e", "df")
    w = Window.partitionBy("cls")
    shared = el.join(often, "e").withColumn("c", F.count("*").over(w)).filter(10 * F.col("c") >= 8 * F.col("n"))
    ranked = shared.withColumn("r", F.row_number().over(w.orderBy("df", "e")) + F.col("n") - F.col("c"))
    side = lambda x, part: ranked.filter(F.col("r") <= F.floor(F.col("n") / part) + 1).select("e", *[F.col(c).alias(f"{x}_{c}") for c in ("cls", "n", "root", "c", "r")])
    u, v, c = side("u", 5), side("v", 9), F.col
    fits = (c("u_root") != c("v_root")) & ((c("u_n") > c("v_n")) | ((c("u_n") == c("v_n")) & (c("u_cls") > c("v_cls"))))
    must = 4 * (c("u_n") + c("v_n"))
    fits &= (9 * F.least("u_c", "v_c") >= must) & (9 * (1 + F.least(c("u_n") - c("u_r"), c("v_n") - c("v_r"))) >= must)
    return u.join(v, "e").filter(fits).select(F.least("u_cls", "v_cls").alias("u"), F.greatest("u_cls", "v_cls").alias("v")).distinct()


def links(classes: DataFrame, docs: DataFrame, k: int, sketch: int) -> DataFrame | None:
    """Roots (node, root) of the classes that have confirmed links; see the steps above."""
    lists = materialize(inverted_lists(classes), "lists")
    if lists.isEmpty():
        return None
    members = lists.select("cls").distinct()
    members = materialize(classes.select("cls", "n", "low").join(small(members), "cls", "left_semi"), "members")
    ids = small(members.select(F.col("cls.doc_id").alias("doc_id"), F.col("cls.th").alias("th"), "cls"))
    raw = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), F.col("text").cast("string"))
    texts = materialize(raw.join(ids, ["doc_id", "th"]).select("cls", "text").dropDuplicates(["cls"]), "texts")
    def on_words(pairs: DataFrame, few: bool = True) -> DataFrame:
        own = texts
        if few:
            pairs = materialize(pairs, "hopeful")
            own = texts.join(small(pairs.select(F.explode(F.array("u", "v")).alias("cls")).distinct()), "cls", "left_semi")
        return materialize(compared(pairs, own, k), "compared")

    # Each list has one pivot.
    pivots = lists.groupBy("value").agg(F.min("cls").alias("pivot"))
    met = materialize(lists.join(pivots, "value").filter("cls <> pivot"), "met")
    pairs = met.select(F.col("pivot").alias("u"), F.col("cls").alias("v")).distinct()
    close = on_words(hopeful(pairs, members, sketch, CLOSE, CLOSE_HOPE), few=False)
    roots = merged(None, close.filter("ok").select("u", "v"))
    # What is close to a pivot, by differences; pivots whose company has one root have nothing to find.
    own = rooted(close.filter("diff is not null").select(F.col("u").alias("pivot"), F.col("v").alias("cls"), "n", "ok", "diff"), roots)
    several = own.groupBy("pivot").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("pivot")
    more = on_words(hopeful(by_differences(own.join(several, "pivot", "left_semi")), members, sketch)).filter("ok").select("u", "v")
    # The rest: lists with several roots among the members that their pivots did not settle.
    settled = close.filter("ok").select(F.col("u").alias("pivot"), F.col("v").alias("cls"))
    rest = rooted(met.join(settled, ["pivot", "cls"], "left_anti").select("value", "cls"), roots)
    several = rest.groupBy("value").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("value")
    rest = materialize(rest.join(several, "value", "left_semi").select("cls", "root").distinct(), "rest")
    if rest.isEmpty():
        return merged(roots, more)
    rest = members.select("cls", "n").join(rest, "cls")
    elements = shingles(texts.join(small(rest.select("cls")), "cls", "left_semi"), k)
    pairs = by_prefixes(materialize(elements.join(rest, "cls"), "elements"))
    return merged(roots, more.unionByName(on_words(hopeful(pairs, members, sketch)).filter("ok").select("u", "v")))


def near_duplicates(docs: DataFrame, k: int = 5, sketch: int = SKETCH) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are lower-cased (A-Z); a text with fewer than ``k`` words is one shingle; null and blank texts are linked with
    nothing. Rows with one doc_id are one document, linked with whatever any of them is; a null doc_id is linked with
    nothing, has no component and is kept. Equal rows give equal rows; an empty table gives none.
    """
    made = materialize(profiles(docs, k, sketch), "profiles")
    usable = made.filter("n > 0 and doc_id is not null")
    classes = materialize(usable.groupBy("a", "b").agg(F.min(F.struct("doc_id", "th")).alias("cls"), F.first("n").alias("n"), F.first("low").alias("low")), "classes")
    roots = links(classes, docs, k, sketch)
    of = classes.select("a", "b", F.col("cls").alias("root"))
    if roots is not None:
        of = of.withColumnRenamed("root", "node").join(roots, "node", "left").select("a", "b", F.coalesce("root", "node").alias("root"))
    rows = made.join(of, ["a", "b"], "left").select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("root.doc_id")).alias("root"))
    rows = same_ids(materialize(rows, "rooted"))
    component = F.coalesce("root", "doc_id")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def same_ids(rows: DataFrame) -> DataFrame:
    """Joins components that share a doc_id (only if ids repeat with other texts)."""
    several = rows.filter("root is not null").groupBy("doc_id").agg(F.min("root").alias("u"), F.max("root").alias("v")).filter("u < v")
    if several.isEmpty():
        return rows
    ids = several.select("doc_id", "u").join(rows.select("doc_id", F.col("root").alias("v")), "doc_id").select("u", "v")
    merged = components(ids).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return rows.join(merged, "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all ``documents`` by 2-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), k=2)


#: The same rows in DuckDB: sets of word pairs, their intersections by a join, and reachability.
ORACLE_SQL = {
    "op6_near_duplicates": r"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) = 1 then [w[1]] else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s from w),
el as (select doc_id, len(s) as n, unnest(s) as e from sets),
common as (select a.doc_id as u, b.doc_id as v, a.n as nu, b.n as nv, count(*) as c from el a join el b on a.e = b.e and a.doc_id <> b.doc_id group by all),
link as (select u, v from common where 100 * c >= 80 * (nu + nv - c)),
reach(u, v) as (select doc_id, doc_id from sets union select reach.u, link.v from reach join link on reach.v = link.u)
select doc_id, cast(len(s) as bigint) as n_shingles, least(doc_id, m) as component_id, doc_id = least(doc_id, m) as kept from sets join (select u, min(v) as m from reach group by u) on u = doc_id"""
}
QUERIES = {"op6_near_duplicates": op6_near_duplicates}
