"""What folds fit on their training weeks: edges of the online risk, its totals and prior, and category codes.

One scan of the features gathers a delta for each week, edge and category value. Deltas add up, so the state of any fold
is the sum of the weeks before its valid week; the states of all folds are merged from the deltas at once, stored in a
folder for each fold, and read from there. A new week adds its own delta and touches no other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.scalars import token
from causeway.operators import encode, risk
from causeway.operators.risk import RiskState
from causeway.sources.sinks import store

TOTAL = "total"


def weekly_deltas(features: DataFrame, columns: list[str], key_sets: list[list[str]]) -> DataFrame:
    """(week_start, kind, key, n, cnt, pos, last_ts, first) from one scan of the features.

    ``kind`` is the name of an edge set, a category column, or ``TOTAL``; ``key`` its values. Edges and totals take labeled
    rows: ``cnt`` of them, ``pos`` positives, ``last_ts`` the last; a category takes all: ``n``, and the first event's id.
    """
    labeled = F.col("target") >= 0
    piece = lambda kind, values: F.struct(F.lit(kind).alias("kind"), F.array(*values).cast("array<string>").alias("key"))
    edges = [F.when(labeled, piece(risk.prefix_name(keys), [risk.key_text(k) for k in keys])) for keys in key_sets]
    parts = F.array_compact(F.array(F.when(labeled, piece(TOTAL, [])), *edges, *[piece(c, [token(c)]) for c in columns]))
    long = features.select("week_start", "event_id", "event_ts", "target", F.explode(parts).alias("e"))
    return long.groupBy("week_start", "e.kind", "e.key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(labeled).alias("cnt"), F.count_if(F.col("target") == 1).alias("pos"),
        F.max(F.when(labeled, F.col("event_ts"))).alias("last_ts"), F.min("event_id").alias("first"),
    )


@dataclass
class FoldStates:
    """``edges``: (fold, kind, key, cnt, pos, last_ts); ``codes``: (fold, col, value, code, n); ``totals``: labeled rows and
    positives by fold."""

    edges: DataFrame
    codes: DataFrame
    totals: dict[int, tuple[int, int]]
    prior: float | str
    alpha: float

    def prior_of(self, fold: int) -> float:
        if self.prior != "train_rate":
            return float(self.prior)
        n, p = self.totals.get(fold, (0, 0))
        return p / n if n else 0.5

    def risk(self, fold: int, key_sets: list[list[str]]) -> dict[str, RiskState]:
        """The frozen edges that the valid week of a fold reads."""
        out = {}
        for keys in key_sets:
            name = risk.prefix_name(keys)
            own = self.edges.filter((F.col("fold") == fold) & (F.col("kind") == name))
            out[name] = RiskState(own.select(*[F.col("key")[i].alias(f"_{k}") for i, k in enumerate(keys)], "cnt", "pos", "last_ts"), self.totals.get(fold, (0, 0)), self.prior_of(fold), self.alpha)
        return out

    def categories(self, fold: int) -> DataFrame:
        return self.codes.filter(F.col("fold") == fold).drop("fold")


def fold_states(deltas: DataFrame, folds: list[tuple], columns: list[str], prior: float | str = 0.5, alpha: float = 20.0) -> FoldStates:
    """The states of all ``folds`` (fold, valid week; no week: after all weeks) from weekly deltas."""
    upto = F.explode(F.array_compact(F.array(*[F.when((F.col("week_start") < F.lit(w)) if w is not None else F.lit(True), F.lit(f)) for f, w in folds]))).alias("fold")
    merged = deltas.select("*", upto).groupBy("fold", "kind", "key").agg(*[F.sum(c).alias(c) for c in ("n", "cnt", "pos")], F.max("last_ts").alias("last_ts"), F.min("first").alias("first"))
    merged = store(merged, "fold-states", ("fold", "kind"))
    firsts = merged.filter(F.col("kind").isin(*columns)).select("fold", F.col("kind").alias("col"), F.col("key")[0].alias("value"), "first", "n")
    codes = store(encode.numbered(firsts, ["fold", "col"]).select("fold", "col", "value", "code", "n"), "fold-codes", ("fold",))
    totals = {r.fold: (r.cnt, r.pos) for r in merged.filter(F.col("kind") == TOTAL).select("fold", "cnt", "pos").collect()}  # a row for each fold
    return FoldStates(merged.filter(~F.col("kind").isin(*columns)), codes, totals, prior, alpha)
