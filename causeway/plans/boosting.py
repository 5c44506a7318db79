"""Second-order boosted trees for a binary label: regularised gains, child weight by hessian, rows and columns sampled by tree.

Features are binned once, by quantiles, and the binned rows are stored. For each tree every row gets its gradient and
hessian in one write; for each level of it one aggregation sums them up by node, feature and bin, which tasks do in part
before anything is shuffled, and a window over the bins of a node and feature finds the gains. The driver receives the
best split of each node, at most one for each open node. Sums are whole numbers (``UNIT`` to one), so that neither splits
nor leaves depend on how rows are dealt.
"""

from __future__ import annotations

import json
import math
import random
from dataclasses import asdict, dataclass, field

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.sources.sinks import store

UNIT = 1 << 24
TREE = "feature: array<int>, bin: array<int>, value: array<double>"


@dataclass(frozen=True)
class Settings:
    trees: int = 100
    depth: int = 6
    rate: float = 0.05
    reg_lambda: float = 1.0
    gamma: float = 0.0
    min_child_weight: float = 1.0
    subsample: float = 1.0
    columns_by_tree: float = 1.0
    bins: int = 64
    seed: int = 42


@dataclass
class Tree:
    """Nodes in the order of a heap: the feature and last bin on the left of a split, -1 and the value of a leaf."""

    feature: list[int]
    bin: list[int]
    value: list[float]
    gain: list[float]


@dataclass
class Booster:
    features: list[str]
    splits: list[list[float]]
    settings: Settings
    trees: list[Tree] = field(default_factory=list)

    def margins(self, df: DataFrame, name: str = "margin") -> DataFrame:
        """``df`` with the sum of the trees' values."""
        rows = binned(df, self.features, self.splits, "_bins")
        return rows.withColumn(name, margin(self.trees, self.settings, F.col("_bins"))).drop("_bins")

    def importance(self) -> list[tuple[str, float]]:
        """Features by the sum of the gains of their splits."""
        total = dict.fromkeys(self.features, 0.0)
        for t in self.trees:
            for f, g in zip(t.feature, t.gain, strict=True):
                if f >= 0:
                    total[self.features[f]] += g
        return sorted(total.items(), key=lambda x: -x[1])

    def to_json(self) -> str:
        return json.dumps(asdict(self))


def from_json(text: str) -> Booster:
    x = json.loads(text)
    return Booster(x["features"], x["splits"], Settings(**x["settings"]), [Tree(**t) for t in x["trees"]])


def quantile_splits(df: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Inner edges of each feature's bins; a feature without values has none."""
    numbers = df.select(*[F.nanvl(F.col(f).cast("double"), F.lit(None)).alias(str(i)) for i, f in enumerate(features)])
    found = numbers.approxQuantile([str(i) for i in range(len(features))], [k / bins for k in range(1, bins)], 0.1 / bins)
    return [sorted({float(x) for x in edges}) for edges in found]


def binned(df: DataFrame, features: list[str], splits: list[list[float]], name: str) -> DataFrame:
    """``name``: the bin of each feature, from 0; a value at an edge is above it, and missing values are above all."""
    inf, cols = float("inf"), [f"_v{i}" for i in range(len(features))]
    numbers = df.withColumns({c: F.col(f).cast("double") for c, f in zip(cols, features, strict=True)})
    made = Bucketizer(splitsArray=[[-inf, *s, inf] if s else [-inf, 0.0, inf] for s in splits], inputCols=cols, outputCols=[f"{c}b" for c in cols], handleInvalid="keep").transform(numbers)
    return made.withColumn(name, F.array(*[F.coalesce(F.col(f"{c}b").cast("int"), F.lit(max(len(s), 1) + 1)) for c, s in zip(cols, splits, strict=True)])).drop(*cols, *[f"{c}b" for c in cols])


def leaf_of(tree: Column, bins: Column, depth: int) -> Column:
    """The node in which a row ends."""

    def step(n: Column, _: Column) -> Column:
        f = F.get(tree["feature"], n)
        return F.when(f < 0, n).otherwise(2 * n + 1 + (F.get(bins, f) > F.get(tree["bin"], n)).cast("int"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)


def as_column(trees: list[Tree]) -> Column:
    """Trees as a constant of bounded size, an array that the optimizer makes once out of text."""
    rows = [{"feature": t.feature, "bin": t.bin, "value": t.value} for t in trees]
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{TREE}>>")


def margin(trees: list[Tree], s: Settings, bins: Column) -> Column:
    if not trees:
        return F.lit(0.0)
    return F.aggregate(as_column(trees), F.lit(0.0), lambda m, t: m + F.get(t["value"], leaf_of(t, bins, s.depth)))


def best_splits(rows: DataFrame, columns: list[int], s: Settings) -> DataFrame:
    """(node, f, bin, gain, g, h, gl, hl) of the best split of each node of ``rows`` (node, bins, g, h); gain is null if there is none.

    Of equal gains the first feature and bin wins.
    """
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.get("bins", F.lit(f)).alias("bin")) for f in columns]))
    sums = rows.select("node", "g", "h", each.alias("e")).groupBy("node", "e.f", "e.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    w = Window.partitionBy("node", "f")
    upto = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    found = sums.select("node", "f", "bin", *[F.sum(c).over(upto).alias(f"{c}l") for c in "gh"], *[F.sum(c).over(w).alias(f"{c}t") for c in "gh"])
    real = lambda c: F.col(c) / F.lit(float(UNIT))
    score = lambda g, h: g * g / (h + s.reg_lambda)
    gl, hl, gt, ht = (real(c) for c in ("gl", "hl", "gt", "ht"))
    gain = 0.5 * (score(gl, hl) + score(gt - gl, ht - hl) - score(gt, ht)) - s.gamma
    fits = (hl >= s.min_child_weight) & (ht - hl >= s.min_child_weight) & (gain > 1e-9)
    found = found.withColumn("gain", F.when(fits, F.round(gain, 9)))
    first = F.struct(F.coalesce("gain", F.lit(-1.0)).alias("o"), (-F.col("f")).alias("a"), (-F.col("bin")).alias("b"))
    best = found.groupBy("node").agg(F.max_by(F.struct("f", "bin", "gain", F.col("gt").alias("g"), F.col("ht").alias("h"), "gl", "hl"), first).alias("x"))
    return best.select("node", "x.*")


def grow(rows: DataFrame, columns: list[int], s: Settings) -> Tree:
    """One tree over ``rows`` (bins, g, h)."""
    size = (1 << (s.depth + 1)) - 1
    t = Tree([-1] * size, [0] * size, [0.0] * size, [0.0] * size)
    value = lambda g, h: -s.rate * (g / UNIT) / (h / UNIT + s.reg_lambda)
    live = [0]
    for level in range(s.depth):
        at = F.lit(0) if not level else leaf_of(as_column([t])[0], F.col("bins"), level)
        placed = rows.withColumn("node", at).filter(F.col("node").isin(*live)) if level else rows.withColumn("node", at)
        found, live = best_splits(placed, columns, s).collect(), []  # a row for each open node
        for r in sorted(found, key=lambda r: r.node):
            if not level:
                t.value[0] = value(r.g, r.h)
            if r.gain is None:
                continue
            t.feature[r.node], t.bin[r.node], t.gain[r.node] = r.f, r.bin, r.gain
            left = 2 * r.node + 1
            t.value[left], t.value[left + 1] = value(r.gl, r.hl), value(r.g - r.gl, r.h - r.hl)
            live += [left, left + 1]
        if not live:
            break
    return t


def sampled_columns(n: int, tree: int, s: Settings) -> list[int]:
    return sorted(random.Random(s.seed * 1_000_003 + tree).sample(range(n), max(1, round(s.columns_by_tree * n))))


def fit(train: DataFrame, features: list[str], s: Settings | None = None, order: str = "event_id") -> Booster:
    """Trees on ``y`` (0 or 1) with ``weight``; ``order`` keys the sampling of rows. No rows give trees of no value."""
    s = s or Settings()
    out = Booster(features, quantile_splits(train, features, s.bins), s)
    rows = store(binned(train, features, out.splits, "bins").select(F.col(order).alias("id"), F.col("y").cast("double").alias("y"), F.col("weight").cast("double").alias("w"), "bins", F.lit(0.0).alias("margin")), "binned")
    for k in range(s.trees):
        p = 1 / (1 + F.exp(-F.col("margin")))
        whole = lambda x: F.round(x * UNIT).cast("long")
        now = rows.withColumn("margin", F.col("margin") + margin(out.trees[-1:], s, F.col("bins")))
        rows = store(now.withColumns({"g": whole((p - F.col("y")) * F.col("w")), "h": whole(p * (1 - p) * F.col("w"))}), "gradients")
        chosen = rows
        if s.subsample < 1:
            chosen = rows.filter(F.pmod(F.xxhash64(F.lit(s.seed), F.lit(k), "id"), F.lit(1 << 20)) < math.floor(s.subsample * (1 << 20)))
        out.trees.append(grow(chosen, sampled_columns(len(features), k, s), s))
    return out
