import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from causeway.llm import manifest as M


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(*values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, arity=3):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h("".join(last[i : i + arity])) for i in range(0, len(last), arity)])
    return levels


def siblings(levels, i, arity=3):
    """(before, after) on each level."""
    out = []
    for level in levels[:-1]:
        lo = i - i % arity
        out.append(("".join(level[lo:i]), "".join(level[i + 1 : lo + arity])))
        i //= arity
    return out


def brute(rows, arity=3):
    groups = defaultdict(list)
    for d, text, lang, source, n in rows:
        even = d is not None and zlib.crc32(str(d).encode()) % 2 == 0
        seen = text.replace("\n", "") if even and text is not None else text
        groups[source].append((d is not None, d or 0, leaf(d, source, lang, n, text), leaf(d, source, lang, n, seen)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(groups[s])], arity) for s in names}
    crown = climb([trees[s][-1][0] for s in names], arity)
    out = []
    for g, s in enumerate(names):
        for i, (known, d, own, seen) in enumerate(sorted(groups[s])):
            path = siblings(trees[s], i, arity) + siblings(crown, g, arity)
            folded = seen
            for before, after in path:
                folded = h(before + folded + after)
            root = crown[-1][0]
            out.append((d if known else None, own, trees[s][-1][0], root, h("".join(a + b for a, b in path)), folded, folded == root))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def run(spark, tmp_path, df):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = M.op13_merkle_manifest(spark, str(tmp_path))
    assert out.columns == COLUMNS
    return sorted(map(tuple, out.collect()), key=str)


def test_against_brute_force(spark, few, rows, tmp_path):
    got = run(spark, tmp_path, few.withColumn("g", F.lit(1)).withColumn("path", F.lit("x")))
    assert got == sorted(brute(rows), key=str)
    assert any(x[6] for x in got) and not all(x[6] for x in got)


@pytest.mark.parametrize("sizes", [(1,), (2,), (3,), (4,), (9, 1), (10, 27, 28, 1, 1, 1)])
def test_shapes(spark, tmp_path, sizes):
    made = [(100 * g + i, f"line {i}\nend", "en", f"s{g}" if g else None, i) for g, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars int")
    assert run(spark, tmp_path, df) == sorted(brute(made), key=str)


def test_binary(spark):
    """In a tree of two the sibling is the place with its last bit flipped."""
    made = [(i, h(str(i))) for i in range(13)]
    out = M.manifest(spark.createDataFrame([("g", *x) for x in made], "source string, doc_id long, leaf string"), arity=2)
    levels = climb([x[1] for x in made], 2)
    for r in out.withColumn("folded", M.fold(F.col("leaf"), F.col("path"))).collect():
        assert r.root == r.folded == levels[-1][0]
        assert [x for p in r.path for x in p if x] == [level[j] for level, j in zip(levels, [(r.place >> k) ^ 1 for k in range(9)], strict=False) if j < len(level)]


def test_empty(spark, none, tmp_path):
    assert run(spark, tmp_path, none) == []
