"""Second-order boosting against a plain version, split by split."""

import math
import random

import pytest
from pyspark.sql import functions as F

from causeway.plans import boosting as B
from causeway.plans import model

FEATURES = ["a", "b", "c"]


def rows_of(n, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = rng.randrange(12) / 3, rng.choice([None, float("nan"), 1.0, 2.0, 5.0]), rng.gauss(0, 1)
        z = a - 2 + (1.5 if b == 5.0 else 0) + (0.7 if b is None or b != b else 0)
        out.append((i, a, b, c, int(rng.random() < 1 / (1 + math.exp(-z))), rng.choice([1.0, 0.5])))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "event_id long, a double, b double, c double, y int, weight double")


def bin_of(x, splits):
    if x is None or x != x:
        return max(len(splits), 1) + 1
    return sum(x >= e for e in splits)


def plain_tree(rows, columns, s):
    """(split of each node, value of each node) of rows (bins, g, h), in whole units."""
    size = (1 << (s.depth + 1)) - 1
    feature, bins, values = [-1] * size, [0] * size, [0.0] * size
    score = lambda g, h: (g / B.UNIT) ** 2 / (h / B.UNIT + s.reg_lambda)
    value = lambda g, h: -s.rate * (g / B.UNIT) / (h / B.UNIT + s.reg_lambda)
    todo = [(0, rows)]
    values[0] = value(sum(r[1] for r in rows), sum(r[2] for r in rows))
    while todo:
        node, own = todo.pop()
        if node >= (1 << s.depth) - 1:
            continue
        g, h, best = sum(r[1] for r in own), sum(r[2] for r in own), None
        for f in columns:
            for cut in sorted({r[0][f] for r in own}):
                left = [r for r in own if r[0][f] <= cut]
                gl, hl = sum(r[1] for r in left), sum(r[2] for r in left)
                gain = round(0.5 * (score(gl, hl) + score(g - gl, h - hl) - score(g, h)) - s.gamma, 9)
                if hl / B.UNIT >= s.min_child_weight and (h - hl) / B.UNIT >= s.min_child_weight and gain > 1e-9 and (best is None or gain > best[0]):
                    best = (gain, f, cut, gl, hl)
        if best:
            _, feature[node], bins[node], gl, hl = best
            values[2 * node + 1], values[2 * node + 2] = value(gl, hl), value(g - gl, h - hl)
            todo += [(2 * node + 1, [r for r in own if r[0][best[1]] <= best[2]]), (2 * node + 2, [r for r in own if r[0][best[1]] > best[2]])]
    return feature, bins, values


def ends(tree, bins):
    n = 0
    while tree[0][n] >= 0:
        n = 2 * n + 1 + (bins[tree[0][n]] > tree[1][n])
    return tree[2][n]


@pytest.mark.parametrize("settings", [B.Settings(trees=3, depth=3, rate=0.3, bins=8, min_child_weight=2.0), B.Settings(trees=2, depth=2, bins=5, reg_lambda=5.0, gamma=0.05, columns_by_tree=0.67)])
def test_splits_equal_a_plain_version(spark, settings, tmp_path):
    rows = rows_of(240)
    got = B.fit(frame(spark, rows).repartition(5), FEATURES, settings)
    binned = [[bin_of(x, s) for x, s in zip(r[1:4], got.splits, strict=True)] for r in rows]
    margins = [0.0] * len(rows)
    for k, t in enumerate(got.trees):
        p = [1 / (1 + math.exp(-m)) for m in margins]
        whole = [(b, round((q - r[4]) * r[5] * B.UNIT), round(q * (1 - q) * r[5] * B.UNIT)) for b, q, r in zip(binned, p, rows, strict=True)]
        want = plain_tree(whole, B.sampled_columns(3, k, settings), settings)
        assert t.feature == want[0]
        assert all(x == y for x, y, f in zip(t.bin, want[1], want[0], strict=True) if f >= 0)
        assert all(abs(x - y) < 1e-6 for x, y in zip(t.value, want[2], strict=True))
        margins = [m + ends((t.feature, t.bin, t.value), b) for m, b in zip(margins, binned, strict=True)]
    plan = got.margins(frame(spark, rows))._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "JsonToStructs" not in plan  # the trees are a constant
    scored = {r.event_id: r.margin for r in got.margins(frame(spark, rows)).collect()}
    assert all(abs(scored[r[0]] - m) < 1e-9 for r, m in zip(rows, margins, strict=True))
    assert any(f >= 0 for t in got.trees for f in t.feature) and got.importance()[0][1] > 0
    model.save(got, str(tmp_path / "model"))
    again, names = model.load(str(tmp_path / "model"))
    assert names == FEATURES and {r.event_id: r.margin for r in model.score(again, frame(spark, rows), names).collect()} == scored


def test_trees_do_not_depend_on_how_rows_are_dealt(spark):
    s = B.Settings(trees=2, depth=3, bins=6, subsample=0.7)
    rows = rows_of(200, 9)
    splits = [[1.0, 2.0, 3.0], [2.0], [0.0]]
    made = []
    for n in (1, 6):
        df = B.binned(frame(spark, rows).repartition(n), FEATURES, splits, "bins").select("bins", F.round((0.5 - F.col("y")) * B.UNIT).cast("long").alias("g"), F.lit(B.UNIT // 4).cast("long").alias("h"))
        made.append(B.grow(df, [0, 1, 2], s))
    assert made[0] == made[1]


def test_child_weight_and_no_rows(spark):
    rows = rows_of(60)
    t = B.fit(frame(spark, rows), FEATURES, B.Settings(trees=1, depth=2, bins=4, min_child_weight=1e6)).trees[0]
    assert set(t.feature) == {-1}
    none = B.fit(frame(spark, []), FEATURES, B.Settings(trees=1, depth=2, bins=4))
    assert {r.margin for r in none.margins(frame(spark, rows)).collect()} == {0.0}
