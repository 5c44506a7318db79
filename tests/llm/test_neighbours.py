import numpy as np
from pyspark.sql import functions as F

from causeway.llm import neighbours as V


def brute(rows, ids):
    x = {i: np.array(v) for i, v in rows}
    out = {}
    for q in ids:
        d = sorted((float(np.sqrt(((v - x[q]) ** 2).sum())), i) for i, v in rows if i != q)
        out[q] = d[:10]
    return out


def test_recall(spark, sf):
    """Over all rows of the largest small table, and again with many clusters."""
    for path, step in ((f"{sf}/embeddings.parquet", 5), ("/root/testdata/sf0.1/embeddings.parquet", 50)):
        df = spark.read.parquet(path)
        rows = [(r.vec_id, r.embedding) for r in df.collect()]
        ids = [i for i, _ in rows if i % step == 0]
        want = brute(rows, ids)
        got = {}
        for r in V.nearest(df, F.col("id") % step == 0).collect():
            got.setdefault(r.query_id, {})[r.rank] = (r.score, r.vec_id)
        assert sorted(got) == sorted(ids) and all(sorted(g) == list(range(1, 11)) for g in got.values())
        hit = sum(len({i for _, i in want[q]} & {i for _, i in got[q].values()}) for q in ids)
        assert hit / (10 * len(ids)) >= 0.9
        for q in ids:
            assert [got[q][k] for k in range(1, 11)] == sorted(got[q].values())


def test_clusters_prune_and_cells_split(spark, monkeypatch):
    """Where vectors have structure few parts are visited; small cells give the same rows."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((64, 16))[rng.integers(0, 64, 3000)] * 4 + rng.standard_normal((3000, 16)) * 0.3
    router, visits = V.fit_router(x)
    assert router.w[3].size == 16 and visits <= 8
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    ids = list(range(0, 3000, 10))
    want = brute(list(enumerate(x)), ids)
    got = V.nearest(df, F.col("id") % 10 == 0).collect()
    assert sum(r.vec_id in {i for _, i in want[r.query_id]} for r in got) >= 0.9 * 10 * len(ids)
    monkeypatch.setattr(V, "CELL_QUERIES", 7)
    monkeypatch.setattr(V, "CELL_ROWS", 50)
    assert sorted(map(tuple, got)) == sorted(map(tuple, V.nearest(df, F.col("id") % 10 == 0).collect()))


def test_parts_rise_with_the_rows(spark, monkeypatch):
    """More parts leave a query a smaller share of the rows, with the recall that is asked for."""
    assert [V.parts_for(n) for n in (0, 1_000_000, 2_000_000, 10**12)] == [16, 16, 32, 128]
    rng = np.random.default_rng(6)
    x = rng.standard_normal((128, 16))[rng.integers(0, 128, 6000)] * 4 + rng.standard_normal((6000, 16)) * 0.3
    monkeypatch.setattr(V, "ROWS_OF_PART", 100)
    parts = V.parts_for(len(x))
    router, visits = V.fit_router(x, parts)
    _, before = V.fit_router(x)
    assert router.w[3].size == parts == 64 and visits / parts < before / V.PARTS
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    ids = list(range(0, 6000, 40))
    want = brute(list(enumerate(x)), ids)
    got = V.nearest(df, F.col("id") % 40 == 0).collect()
    assert len(got) == 10 * len(ids) and sum(r.vec_id in {i for _, i in want[r.query_id]} for r in got) >= 0.9 * 10 * len(ids)


def test_ties_and_odd_rows(spark, none):
    same = [(i, [1.0, 2.0]) for i in range(100, 160)]
    odd = [(1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (6, [1.0, 2.0, 3.0]), (None, [1.0, 2.0])]
    df = spark.createDataFrame([*same, (0, [1.0, 2.5]), *odd, (100, [1.0, 2.0])], "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = V.nearest(df, F.col("id").isin(0, 100, 3)).collect()
    by = {}
    for r in sorted(got, key=lambda r: r.rank):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(by) == {0, 100}
    assert by[100] == [(i, 0.0) for i in range(101, 111)]
    assert [i for i, _ in by[0]] == [100, 100, *range(101, 109)] and all(s == 0.5 for _, s in by[0])
    few = spark.createDataFrame([(0, [1.0]), (100, [2.0]), (7, [4.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id, r.score) for r in V.nearest(few, F.col("id") == 0).orderBy("rank").collect()] == [(0, 100, 1.0), (0, 7, 3.0)]
    assert V.nearest(few.limit(0), F.col("id") == 0).count() == 0


def test_balanced():
    x = np.random.default_rng(0).standard_normal((640, 8))
    parts = np.bincount(V.balanced_parts(V.neighbour_graph(x, 10), 16, 1))
    assert parts.tolist() == [40] * 16
