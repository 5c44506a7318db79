"""Smoothed risk of (customer, attribute) edges, read before write, in global event order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.scalars import smoothed
from causeway.operators.ordered import deal, most, total
from causeway.sources.sinks import store

KEYS = {"mcc": ["customer_id", "mcc_code"], "channel": ["customer_id", "channel_indicator_sub_type"], "event_type": ["customer_id", "event_type_nm"]}
NONE = "__NA__"


@dataclass
class RiskState:
    """Counts, positives and last time of every edge; the global counts; prior and smoothing."""

    edges: DataFrame
    total: tuple[int, int]
    prior: float
    alpha: float


def key_text(k: str) -> Column:
    """A key as edges hold it; null is a value."""
    return F.coalesce(F.col(k).cast("string"), F.lit(NONE))


def prefix_name(keys: list[str]) -> str:
    return "ogr_" + "__".join(keys)


def weighted_prior(df: DataFrame, weight: str | None = None) -> DataFrame:
    """One row ``prior``: the weighted share of positives among labeled rows, 0.5 if they have no weight."""
    w = F.col(weight) if weight else F.lit(1.0)
    own = df.filter("target >= 0")
    total = F.sum(w)
    return own.agg(F.coalesce(F.when(total > 0, F.sum(F.when(F.col("target") == 1, w).otherwise(0.0)) / total), F.lit(0.5)).alias("prior"))


def edge_state(df: DataFrame, keys: list[str], labeled_only: bool = True) -> DataFrame:
    rows = df.filter("target >= 0") if labeled_only else df
    named = rows.select(*[key_text(k).alias(f"_{k}") for k in keys], "target", "event_ts")
    return named.groupBy(*[f"_{k}" for k in keys]).agg(F.count(F.lit(1)).alias("cnt"), F.sum((F.col("target") == 1).cast("long")).alias("pos"), F.max("event_ts").alias("last_ts"))


ORDER = ["event_ts", "event_id"]


def history(df: DataFrame, key_sets: list[list[str]], counted: Column, parts: int | None = None) -> DataFrame:
    """``df`` with what counted rows before each row, in (event_ts, event_id) order, have been: rows and positives of all
    (``_gn``, ``_gp``), and rows, positives and last time of each edge (``_sc_``, ``_sp_``, ``_sl_`` and its name).

    The order of all rows is dealt by ranges, and then the rows of the keys that all sets share, so that neither a busy
    day nor a busy customer is one task. Only keys, order and labels are dealt; the rows, written once with a number each,
    are met by their number.
    """
    rows = store(df.withColumn("_row", F.monotonically_increasing_id()), "risk-rows")
    hit = {"_hit": counted.cast("long"), "_hit_pos": (counted & (F.col("target") == 1)).cast("long")}
    every = dict.fromkeys(f"_{k}" for keys in key_sets for k in keys)
    slim = rows.withColumns(hit).select("_row", *every, *ORDER, *hit)
    n, p, last = F.col("_hit"), F.col("_hit_pos"), F.when(F.col("_hit") > 0, F.col("event_ts"))
    out = deal(slim, [], ORDER, parts).scan({"_gn": total(n, before=True), "_gp": total(p, before=True)}).rows.drop("_part", "_all")
    common = [k for k in key_sets[0] if all(k in s for s in key_sets)]
    t = deal(out, [f"_{k}" for k in common], ORDER, parts)
    for keys in key_sets:
        name = prefix_name(keys)
        t = t.scan({f"_sc_{name}": total(n, before=True), f"_sp_{name}": total(p, before=True), f"_sl_{name}": most(last, before=True)}, tuple(f"_{k}" for k in keys if k not in common))
    return rows.join(t.rows.drop("_part", "_all", *every, *ORDER, *hit), "_row").drop("_row")


def online_risk(
    df: DataFrame, key_sets: list[list[str]], mode: str = "train", prior: float = 0.5, alpha: float = 20.0, state: dict[str, RiskState] | None = None,
    labeled_only: bool = True, include_risk: bool = True, include_count: bool = True, seen: str | None = None, parts: int | None = None,
) -> DataFrame:
    """Adds cnt_prev, is_new, tslast_sec (counts) and pos_prev, risk_smooth (risk) for each set of keys.

    ``train``: rows see the edges as earlier rows left them, and change them if labeled (or all rows, by ``labeled_only``).
    ``valid`` and ``test``: the given state is read and stays. With a state, its prior and smoothing hold. ``seen``: the name of
    a column for how many counted rows came before (``train``); where none did, the risk is the prior.
    """
    if mode not in ("train", "valid", "test"):
        raise ValueError(f"unknown mode {mode}")
    counted = (F.col("target") >= 0) if labeled_only else F.lit(True)
    every = dict.fromkeys(k for keys in key_sets for k in keys)
    out = df.withColumns({f"_{k}": key_text(k) for k in every})
    if mode == "train":
        out = history(out, key_sets, counted, parts)
    for keys in key_sets:
        name = prefix_name(keys)
        own = (state or {}).get(name)
        prior_, alpha_ = (own.prior, own.alpha) if own else (prior, alpha)
        if own:
            out = out.join(own.edges.withColumnsRenamed({"cnt": "_c0", "pos": "_q0", "last_ts": "_l0"}), [f"_{k}" for k in keys], "left")
        else:
            out = out.withColumns({"_c0": F.lit(0).cast("long"), "_q0": F.lit(0).cast("long"), "_l0": F.lit(None).cast("long")})
        cnt, pos, last = F.coalesce("_c0", F.lit(0)), F.coalesce("_q0", F.lit(0)), F.col("_l0")
        n0, p0 = own.total if own else (0, 0)
        if mode == "train":
            cnt, pos, last = cnt + F.col(f"_sc_{name}"), pos + F.col(f"_sp_{name}"), F.coalesce(F.col(f"_sl_{name}"), last)
            gc, gp = F.col("_gn") + n0, F.col("_gp") + p0
            now = F.when(gc > 0, gp / F.greatest(gc, F.lit(1))).otherwise(F.lit(prior_))
        else:
            now = F.lit(p0 / n0 if n0 else prior_)
        out = out.withColumns({"_cnt": cnt, "_pos": pos, "_last": last, "_now": now})
        made = {}
        if include_count:
            made |= {f"{name}_cnt_prev": F.col("_cnt"), f"{name}_is_new": (F.col("_cnt") == 0).cast("int"), f"{name}_tslast_sec": F.coalesce(F.col("event_ts") - F.col("_last"), F.lit(-1))}
        if include_risk:
            made |= {f"{name}_pos_prev": F.col("_pos"), f"{name}_risk_smooth": smoothed(F.col("_pos"), F.col("_cnt"), F.col("_now"), alpha_)}
        out = out.withColumns(made).drop("_cnt", "_pos", "_last", "_now", "_c0", "_q0", "_l0", f"_sc_{name}", f"_sp_{name}", f"_sl_{name}")
    if seen and mode == "train":
        out = out.withColumn(seen, F.col("_gn"))
    return out.drop("_gn", "_gp", *[f"_{k}" for k in every])


def fit_state(df: DataFrame, keys: list[str], prior: float = 0.5, alpha: float = 20.0, labeled_only: bool = True, start: RiskState | None = None) -> RiskState:
    """The state after all rows of ``df``, on top of ``start``."""
    edges = edge_state(df, keys, labeled_only)
    rows = df.filter("target >= 0") if labeled_only else df
    n, p = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("target") == 1).cast("long")), F.lit(0))).first()
    if start:
        both = start.edges.unionByName(edges).groupBy(*[f"_{k}" for k in keys])
        edges = both.agg(F.sum("cnt").alias("cnt"), F.sum("pos").alias("pos"), F.max("last_ts").alias("last_ts"))
        n, p, prior, alpha = n + start.total[0], p + start.total[1], start.prior, start.alpha
    return RiskState(edges, (n, p), prior, alpha)
