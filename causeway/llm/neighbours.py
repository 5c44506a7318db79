"""Approximate nearest neighbours (operator 8): learned partitions.

1. On a bounded sample (``SAMPLE`` rows by a hash of their id, and ``SAMPLE_OF_PART`` for each part) a neighbour graph is
   built and cut into equal parts by repeated spectral bisection at the median. Parts rise with the rows from ``PARTS``
   to ``MOST_PARTS``, so that where vectors have structure a query meets a smaller share of a larger table.
2. A small classifier (one hidden layer, softmax) learns to tell a vector's part, and a held-out quarter of the sample
   tells how many of the most probable parts a query has to visit for ``COVER`` of its neighbours.
3. The classifier gives every row its part. Queries go to their most probable parts; a part is searched in cells of
   bounded size (rows by salt, queries by salt), each query keeps its best of each cell, and these are ranked. A row is
   copied once for each ``CELL_QUERIES`` queries that visit its own part, whatever goes to others.

Distances are computed in double precision on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.llm.common import materialize

SAMPLE, SAMPLE_OF_PART = 4000, 64
#: Parts, and rows of a part beyond which there are more parts.
PARTS, MOST_PARTS, ROWS_OF_PART = 16, 128, 65_536
NEIGHBOURS = 10
COVER = 0.97
HIDDEN = 64
#: Rows and queries that meet in one cell.
CELL_ROWS, CELL_QUERIES = 16_384, 4_096


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of each row's ``k`` nearest other rows."""
    out = np.zeros((len(x), k), np.int64)
    norms = (x * x).sum(1)
    for lo in range(0, len(x), 1000):
        d = norms[lo : lo + 1000, None] + norms[None] - 2 * x[lo : lo + 1000] @ x.T
        d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
        out[lo : lo + 1000] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def bisected(near: np.ndarray, own: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Halves ``own`` (rows of the graph) at the median of the second eigenvector of its normalised graph."""
    place = np.full(near.shape[0], -1)
    place[own] = np.arange(len(own))
    i = np.repeat(np.arange(len(own)), near.shape[1])
    j = place[near[own].ravel()]
    i, j = np.concatenate([i[j >= 0], j[j >= 0]]), np.concatenate([j[j >= 0], i[j >= 0]])
    degree = np.bincount(i, minlength=len(own)) + 1.0
    root = np.sqrt(degree)
    v = rng.standard_normal(len(own))
    for _ in range(60):
        v -= root * (root @ v) / (root @ root)
        u = v / root
        v = 0.5 * (v + (np.bincount(i, u[j], len(own)) + u) / root)
        v /= np.linalg.norm(v) or 1.0
    order = np.argsort(v / root, kind="stable")
    upper = np.zeros(len(own), bool)
    upper[order[len(own) // 2 :]] = True
    return upper


def balanced_parts(near: np.ndarray, parts: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    label = np.zeros(near.shape[0], np.int64)
    size = 1
    while size < parts:
        for p in range(size):
            own = np.flatnonzero(label == p)
            if len(own) > 1:
                label[own[bisected(near, own, rng)]] = p + size
        size *= 2
    return label


class Router:
    """A classifier from a vector to the probabilities of the parts."""

    def __init__(self, dim: int, parts: int, seed: int):
        rng = np.random.default_rng(seed)
        self.w = [rng.standard_normal((dim, HIDDEN)) / np.sqrt(dim), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) / np.sqrt(HIDDEN), np.zeros(parts)]
        self.centre, self.scale = np.zeros(dim), np.ones(dim)

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = (x - self.centre) / self.scale
        return np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]

    def fit(self, x: np.ndarray, label: np.ndarray, steps: int = 300, rate: float = 0.01, decay: float = 1e-3) -> None:
        self.centre, self.scale = x.mean(0), np.maximum(x.std(0), 1e-9)
        z = (x - self.centre) / self.scale
        target = np.eye(self.w[3].size)[label]
        m, s = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        for step in range(1, steps + 1):
            h = np.maximum(z @ self.w[0] + self.w[1], 0)
            y = h @ self.w[2] + self.w[3]
            p = np.exp(y - y.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - target) / len(z)
            gh = (g @ self.w[2].T) * (h > 0)
            for i, d in enumerate((z.T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                d = d + decay * self.w[i]
                m[i], s[i] = 0.9 * m[i] + 0.1 * d, 0.999 * s[i] + 0.001 * d * d
                self.w[i] = self.w[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-8)


def fit_router(x: np.ndarray, parts: int = PARTS, cover: float = COVER, seed: int = 3) -> tuple[Router, int]:
    """The classifier, and how many parts a query visits."""
    x = np.unique(x, axis=0)
    while parts > 1 and len(x) < 40 * parts:
        parts //= 2
    router = Router(x.shape[1], parts, seed)
    if parts == 1:
        return router, 1
    near = neighbour_graph(x, min(NEIGHBOURS, len(x) - 1))
    router.fit(x, balanced_parts(near, parts, seed))
    # The parts that rows are in are the classifier's; a quarter of the sample, unseen by a second fit, tests the routing.
    test = np.random.default_rng(seed).permutation(len(x))[: len(x) // 4]
    rest = np.setdiff1d(np.arange(len(x)), test)
    other = Router(x.shape[1], parts, seed)
    other.fit(x[rest], balanced_parts(neighbour_graph(x[rest], min(NEIGHBOURS, len(rest) - 1)), parts, seed))
    y = other.logits(x)
    rank = np.argsort(np.argsort(-y, axis=1), axis=1)
    visited = rank[np.repeat(test, near.shape[1]), y.argmax(1)[near[test].ravel()]]
    share = np.cumsum(np.bincount(visited, minlength=parts)) / len(visited)
    return router, int(np.searchsorted(share, cover)) + 1


def parts_for(rows: int) -> int:
    """How many parts so many rows are cut into: a power of two times ``PARTS``."""
    parts = PARTS
    while parts < MOST_PARTS and rows > parts * ROWS_OF_PART:
        parts *= 2
    return parts


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the rows whose vectors take part: not null or zero, all components finite, and as long as most."""
    v = F.col("v")
    inf = F.lit(float("inf"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    out = rows.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    out = out.filter(v.isNotNull() & F.col("id").isNotNull()).filter(F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0))
    sizes = out.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return out.filter(F.size("v") == (sizes["d"] if sizes else -1))


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def best_of_cell(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """Each query's ``k`` nearest rows here, exact, ties to smaller ids."""
    empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    if not queries.num_rows or not rows.num_rows:
        return empty
    qid, q, rid, r = queries.column("id").to_numpy(), matrix(queries.column("v")), rows.column("id").to_numpy(), matrix(rows.column("v"))
    rn = (r * r).sum(1)
    out = ([], [], [])
    for lo in range(0, len(q), 256):
        part = q[lo : lo + 256]
        near = rn[None] + (part * part).sum(1)[:, None] - 2 * part @ r.T
        near[qid[lo : lo + 256, None] == rid[None]] = np.inf
        if k < near.shape[1]:
            bound = np.partition(near, k - 1, axis=1)[:, k - 1]
        else:
            bound = np.full(len(part), np.inf)
        # Rounding may move the products by far less than this; all within it are measured exactly, ties too.
        slack = 1e-9 * (rn.max() + (part * part).sum(1))
        for i in range(len(part)):
            some = np.flatnonzero((near[i] <= bound[i] + slack[i]) & (near[i] < np.inf))
            exact = np.sqrt(((r[some] - part[i]) ** 2).sum(1))
            take = np.lexsort((rid[some], exact))[:k]
            out[0].append(np.full(len(take), qid[lo + i]))
            out[1].append(rid[some][take])
            out[2].append(exact[take])
    return pa.table({"query_id": np.concatenate(out[0]), "vec_id": np.concatenate(out[1]), "score": np.concatenate(out[2])})


def nearest(rows: DataFrame, is_query, k: int = 10, key: str = "vec_id", vector: str = "embedding", parts: int | None = None, cover: float = COVER) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` (a column over ``id``) its ``k`` nearest others.

    Rows whose vector is null, zero, holds null or non-finite components, or is of another length than most take no
    part, as query or as candidate; nor do null ids. Rows with the query's id are not its candidates; a repeated id is
    one query (with its least vector) and a candidate for each row. Other columns are ignored; an empty table gives none.
    ``parts`` is a power of two; by default it follows from the number of rows.
    """
    spark = rows.sparkSession
    good = usable(rows, key, vector)
    # The rows of least hash; all but some three times as many are left out before the tasks send their own least ones.
    n = good.count()
    parts = parts or parts_for(n)
    size = max(SAMPLE, SAMPLE_OF_PART * parts)
    share, place_ = min(1.0, 3 * size / max(1, n)), F.pmod(F.xxhash64("id", "v", F.lit(11)), F.lit(1 << 30))
    sample = good.filter(place_ < share * (1 << 30)).orderBy(place_, "id", "v").limit(size).toArrow()
    if not sample.num_rows:  # no rows, or copies of few whose hashes are all too large
        sample = good.limit(size).toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    router, visits = fit_router(matrix(sample.column("v")), parts, cover)
    parts = router.w[3].size

    def place(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(router.logits(matrix(b.column(1))).argmax(1).astype(np.int32))] if b.num_rows else [b.column(0), b.column(1), pa.array([], pa.int32())], names=["id", "v", "part"])

    indexed = materialize(good.mapInArrow(place, "id long, v array<double>, part int"), "indexed")
    count = {r["part"]: r["count"] for r in indexed.groupBy("part").count().collect()}  # at most ``parts`` rows
    sizes = np.array([count.get(p, 0) for p in range(parts)])

    def route(batches):
        for b in batches:
            if not b.num_rows:
                continue
            order = np.argsort(-router.logits(matrix(b.column(1))), axis=1)
            # At least ``visits`` parts, and more while these hold too few rows.
            seen = np.cumsum(sizes[order], axis=1) - sizes[order]
            go = (np.arange(parts)[None] < visits) | (seen < 2 * k + 1)
            i, j = np.nonzero(go)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), b.column(1).take(pa.array(i)), pa.array(order[i, j].astype(np.int32))], names=["id", "v", "part"])

    queries = indexed.filter(is_query).groupBy("id").agg(F.min("v").alias("v")).mapInArrow(route, "id long, v array<double>, part int")
    queries = materialize(queries, "routed")
    visitors = {r["part"]: r["count"] for r in queries.groupBy("part").count().collect()}  # at most ``parts`` rows
    by_part = lambda counts, cell: F.element_at(F.array(*[F.lit(-(-int(n) // cell)) for n in counts]), F.col("part") + 1)
    salts = F.greatest(F.lit(1), by_part(sizes, CELL_ROWS))
    blocks = by_part([visitors.get(p, 0) for p in range(parts)], CELL_QUERIES)
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    q = queries.withColumn("qs", own).withColumn("cs", F.explode(F.sequence(F.lit(0), salts - 1)))
    c = indexed.filter(blocks > 0).withColumn("cs", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), salts).cast("int")).withColumn("qs", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cells = q.groupBy("part", "cs", "qs").cogroup(c.groupBy("part", "cs", "qs"))
    found = cells.applyInArrow(lambda a, b: best_of_cell(a, b, k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of each row of ``embeddings`` whose vec_id is divisible by 100."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0)


QUERIES = {"op8_nearest_neighbours": op8_nearest_neighbours}
