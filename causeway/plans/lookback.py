"""Features of a new week without the history: what it left, and its last seven days.

A feature of an event needs two things of the past. What lasts (numbers, last values and sums of a customer, of a customer's
channel, shop, device or session) is a table for each scan, a row for each key. What expires (frames of up to seven days)
needs the events of the week before, the tail. So a week is made from the tables, the tail and its own events; then the
tail's events join the tables, and the week becomes the next tail.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators.ordered import leave

#: Seconds that frames reach back at most.
REACH = 604_800
ORDER = ["event_ts", "event_id"]
Pack = Callable[..., DataFrame]


@dataclass(frozen=True)
class LookBack:
    """``tables``: what all events before the tail left, by scan; ``tail``: the events of the last seven days."""

    tables: dict[str, DataFrame]
    tail: DataFrame


def totals(events: DataFrame, pack: Pack, past: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """What ``events`` leave after ``past``, a table for each scan of ``pack(events, past=, log=)``."""
    log: list = []
    pack(events, past=past, log=log)
    return leave(log, ORDER, past)


def look_back(history: DataFrame, week_ts: int, pack: Pack, folder: str) -> LookBack:
    """The state before the week that begins at ``week_ts``, from the whole history once; its tables are stored under ``folder``."""
    cut = week_ts - REACH
    return saved(totals(history.filter(F.col("event_ts") < cut), pack), history.filter((F.col("event_ts") >= cut) & (F.col("event_ts") < week_ts)), folder)


def saved(tables: dict[str, DataFrame], tail: DataFrame, folder: str) -> LookBack:
    """Writes a state and reads it; ``folder`` must be new, as the state before this one is read meanwhile."""
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
    tail.write.parquet(f"{folder}/tail")
    return load(tail.sparkSession, folder, list(tables))


def load(spark: SparkSession, folder: str, names: list[str]) -> LookBack:
    return LookBack({n: spark.read.parquet(f"{folder}/{n}") for n in names}, spark.read.parquet(f"{folder}/tail"))


def week_features(state: LookBack, week: DataFrame, pack: Pack) -> DataFrame:
    """Features of the week's events, equal to those of a run over the whole history; it is not read."""
    rows = pack(state.tail.unionByName(week), past=state.tables)
    return rows.join(week.select("event_id"), "event_id", "left_semi")


def advanced(state: LookBack, week: DataFrame, pack: Pack, folder: str) -> LookBack:
    """The state after the week."""
    return saved(totals(state.tail, pack, state.tables), week, folder)
