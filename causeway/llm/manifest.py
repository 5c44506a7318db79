"""Merkle dataset manifest (operator 13): sibling-shift self-joins. DataFrame functions only.

A leaf is the digest of one row; the leaves of a group stand in the order of their ids. On every level each node computes
the places of the other slots of its run of ``arity`` nodes and equijoins the level with itself on them; slot-zero rows
then emit the parents. (In a binary tree that place is the own one with its last bit flipped.) Levels are tables in the
shared folder, a ``arity``-th of the one before each, so a plan never holds more than one level's joins. The subroots of
the groups are the leaves of one tree more, whose top is the root.

Proofs go down the same levels: a node's path is its own siblings and then its parent's path, so each level costs one join
of its nodes with their parents, and not one join of all leaves with every level. No join key is a group alone, so a group
that holds most of the rows is spread like any other; leaves are numbered over range partitions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import id_crc, materialize
from causeway.operators.ordered import running

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """A field as a leaf takes it: ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


@dataclass
class Forest:
    """The trees of all groups: ``levels[l]`` has (g, i, d, left, right) of the nodes that have a parent, ``tops`` a row
    (g, l, d) for each group: the level at which one node was left, and its digest."""

    levels: list[DataFrame]
    tops: DataFrame
    arity: int


def climb(nodes: DataFrame, arity: int = ARITY) -> Forest:
    """Trees over ``nodes`` (g, i, n, d): group, place from 0, the group's nodes, digest. ``left`` and ``right`` are the
    digests of a node's siblings before and after it."""
    levels, tops = [], []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most:
        tops.append(nodes.filter("n = 1").select("g", F.lit(len(tops)).alias("l"), "d"))
        if most == 1:
            break
        live, slot = nodes.filter("n > 1"), F.col("i") % arity
        out = live
        for j in range(1, arity):
            other = live.select(F.col("g").alias(f"g{j}"), F.col("i").alias(f"i{j}"), F.col("d").alias(f"d{j}"))
            out = out.join(other, (F.col("g") == F.col(f"g{j}")) & (F.col("i") - slot + (slot + j) % arity == F.col(f"i{j}")), "left")
        own = lambda before: F.concat_ws("", *[F.when((F.col(f"i{j}") < F.col("i")) == before, F.col(f"d{j}")) for j in range(1, arity)])
        # Join j finds the slot j places on, around the run: those before a node and those after it each come in order.
        level = materialize(out.select("g", "i", "n", "d", own(True).alias("left"), own(False).alias("right")), "level")
        levels.append(level)
        nodes = level.filter(F.col("i") % arity == 0).select("g", F.expr(f"i div {arity}").alias("i"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"), F.sha2(F.concat("d", "right"), 256).alias("d"))
        most = -(-most // arity)
    top = nodes.select("g", F.lit(0).alias("l"), "d") if not tops else tops[0]
    for t in tops[1:]:
        top = top.unionByName(t)
    return Forest(levels, top, arity)


def paths(forest: Forest, above: DataFrame) -> DataFrame:
    """(g, i, path, and the columns of ``above``) of every node of the lowest level: its siblings, level by level, then
    what ``above`` (g, path, ...) says of its group. A path is an array of (left, right)."""
    rest = [c for c in above.columns if c not in ("g", "path")]
    start = materialize(above.join(forest.tops.select("g", "l"), "g"), "tops")
    at = lambda l: start.filter(F.col("l") == l).select("g", F.lit(0).cast("long").alias("i"), "path", *rest)
    out = at(len(forest.levels))
    for l in range(len(forest.levels) - 1, -1, -1):
        parent = out.select(F.col("g").alias("pg"), F.col("i").alias("pi"), F.col("path").alias("up"), *rest)
        nodes = forest.levels[l].withColumn("p", F.expr(f"i div {forest.arity}"))
        met = nodes.join(parent, (F.col("g") == F.col("pg")) & (F.col("p") == F.col("pi")))
        out = met.select("g", "i", F.concat(F.array(F.struct("left", "right")), "up").alias("path"), *rest).unionByName(at(l))
        out = materialize(out, "paths") if l > 1 else out  # the two lowest levels have most of the rows, and stay in one plan
    return out


def proof(path: Column) -> Column:
    """The siblings, level by level, left to right, as one text of digests."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda d, x: F.sha2(F.concat(x["left"], d, x["right"]), 256))


def manifest(docs: DataFrame, group: str = "source", order: str = "doc_id", digest: str = "leaf", arity: int = ARITY, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row for each row of ``docs``: group, order, digest and ``carry`` columns, ``place`` in the group, ``subroot``,
    ``root`` and ``path`` (what ``proof`` and ``fold`` take).

    Null groups are one group, the first; null ids come first in theirs; rows of one id follow in the order of digests, so
    repeated rows are leaves of their own and the result does not depend on how rows are dealt. An empty table gives no
    rows; other columns are ignored, whatever their names.
    """
    own = materialize(docs.select(F.col(group).alias("_s"), F.col(order).alias("_o"), F.col(digest).alias("d"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(carry)]), "leaves")
    sources = own.groupBy("_s").agg(F.count(F.lit(1)).alias("n"))
    sources = materialize(running(sources.withColumn("one", F.lit(1)), [], ["_s"], {"g": "one"}).select(F.col("_s").alias("_name"), "n", F.col("g").cast("long").alias("g")), "groups")
    placed = running(own.withColumn("one", F.lit(1)), ["_s"], ["_o", "d"], {"i": "one"}).withColumn("i", F.col("i").cast("long") - 1)
    placed = materialize(placed.join(sources, F.col("_s").eqNullSafe(F.col("_name"))).drop("_name", "one"), "placed")
    forest = climb(placed.select("g", "i", "n", "d"), arity)
    tops = materialize(forest.tops, "tops")
    forest.tops = tops
    crown = climb(tops.select(F.lit(0).cast("long").alias("g"), (F.col("g") - 1).alias("i"), F.lit(1).alias("one"), "d").crossJoin(tops.agg(F.count(F.lit(1)).alias("n"))).select("g", "i", "n", "d"), arity)
    none = F.array().cast("array<struct<left:string,right:string>>")
    root = crown.tops.select("g", F.col("d").alias("root"), none.alias("path"))  # one row
    of_group = paths(crown, root).select((F.col("i") + 1).alias("g"), "path", "root").join(tops.select("g", F.col("d").alias("subroot")), "g")
    found = paths(forest, of_group).withColumnsRenamed({"g": "_g", "i": "_i"})
    out = placed.join(found, (F.col("g") == F.col("_g")) & (F.col("i") == F.col("_i")))
    return out.select(F.col("_s").alias(group), F.col("_o").alias(order), F.col("d").alias(digest), *[F.col(f"_{k}").alias(c) for k, c in enumerate(carry)], F.col("i").alias("place"), "subroot", "root", "path")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all ``documents``, and each row's proof checked against its tampered or own text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    tampered = F.when(id_crc() % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    own = docs.select("doc_id", "source", leaf_digest(*map(F.col, FIELDS)).alias("leaf"), leaf_digest(*map(F.col, FIELDS[:-1]), tampered).alias("seen"))
    made = manifest(own, carry=("seen",)).withColumns({"folded_root": fold(F.col("seen"), F.col("path")), "proof_sha256": F.sha2(proof(F.col("path")), 256)})
    return made.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: The CRC-32 of the decimal id, bit by bit, and both trees climbed by recursive queries.
_CRC = """list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
 lambda a, b: list_reduce(list_concat([xor(a, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))"""
_FIELD = lambda c: f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')"
_LEAF = lambda text: "sha256(" + " || ".join(_FIELD(c) for c in (*FIELDS[:-1], text)) + ")"


def _sides(t: str, l: str, g: str, i: str) -> str:
    """Siblings of node (l, g, i) of table ``t`` before and after it."""
    side = lambda op: f"coalesce((select string_agg(s.d, '' order by s.i) from {t} s where s.l = {l} and s.g = {g} and s.i // 3 = {i} // 3 and s.i {op} {i}), '')"
    return f"{side('<')} as lft, {side('>')} as rgt"


ORACLE_SQL = {"op13_merkle_manifest": f"""with recursive own as (select doc_id, source, {_LEAF("text")} as leaf,
 case when ({_CRC} & 1) = 1 then {_LEAF("replace(text, chr(10), '')")} else {_LEAF("text")} end as seen from documents),
placed as (select *, dense_rank() over (order by source nulls first) - 1 as g, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by source) as n from own),
t(l, g, i, n, d) as (select 0, g, i, n, leaf from placed union all select l + 1, g, i // 3, (max(n) + 2) // 3, sha256(string_agg(d, '' order by i)) from t where n > 1 group by l, g, i // 3),
tops as (select g, d from t where n = 1),
u(l, g, i, n, d) as (select 0, 0, g, (select count(*) from tops), d from tops union all select l + 1, g, i // 3, (max(n) + 2) // 3, sha256(string_agg(d, '' order by i)) from u where n > 1 group by l, g, i // 3),
root as (select d as root from u where n = 1),
ts as (select l, g, i, n, {_sides("t", "o.l", "o.g", "o.i")} from t o where n > 1),
us as (select l, i, n, {_sides("u", "o.l", "o.g", "o.i")} from u o where n > 1),
up(doc_id, leaf, l, g, i, cur, proof) as (select doc_id, leaf, 0, g, i, seen, '' from placed
 union all select doc_id, leaf, up.l + 1, up.g, up.i // 3, sha256(lft || cur || rgt), proof || lft || rgt from up join ts on ts.l = up.l and ts.g = up.g and ts.i = up.i),
sub as (select doc_id, leaf, g, cur, proof from up where not exists (select 1 from ts where ts.l = up.l and ts.g = up.g and ts.i = up.i)),
vp(doc_id, leaf, g, l, i, cur, proof) as (select doc_id, leaf, g, 0, g, cur, proof from sub
 union all select doc_id, leaf, vp.g, vp.l + 1, vp.i // 3, sha256(lft || cur || rgt), proof || lft || rgt from vp join us on us.l = vp.l and us.i = vp.i)
select doc_id, leaf, tops.d as subroot, root, sha256(proof) as proof_sha256, cur as folded_root, cur = root as verified from vp join tops using (g), root
where not exists (select 1 from us where us.l = vp.l and us.i = vp.i)"""}  # fmt: skip

QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}
