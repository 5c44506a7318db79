"""Category codes by first appearance, labels and sample weights."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.scalars import smoothed, token
from causeway.operators.ordered import deal, running, total
from causeway.sources.sinks import store

# Fixed names: the categorical columns of an event.
CATEGORICAL = [
    "event_type_nm", "event_desc", "channel_indicator_type", "channel_indicator_sub_type", "currency_iso_cd", "mcc_code", "pos_cd", "accept_language", "browser_language", "timezone",
    "session_id", "operating_system_type", "battery", "device_system_version", "screen_size", "developer_tools", "phone_voip_call_state", "web_rdp_connection", "compromised",
]
#: Values that the dictionary of all columns together may hold, and bytes of each. So it has some 15 MB at most.
DICTIONARY_VALUES, DICTIONARY_BYTES = 100_000, 64


def long_values(columns: list[str]) -> Column:
    """(col, value) of each of the columns."""
    return F.array(*[F.struct(F.lit(c).alias("col"), token(c).alias("value")) for c in columns])


def numbered(first: DataFrame, keys: list[str]) -> DataFrame:
    """``code`` of (keys, first, value): values of the same keys in order of their first row, from 0."""
    return running(first.withColumn("_one", F.lit(1)), keys, ["first", "value"], {"code": "_one"}).withColumn("code", F.col("code") - 1).drop("_one")


def fit_categories(df: DataFrame, columns: list[str], order: str = "event_id") -> DataFrame:
    """(col, value, code, n): codes count a column's values in order of their first row; n rows have the value. The table is stored."""
    long = df.select(order, F.explode(long_values(columns)).alias("e")).select(order, "e.*")
    first = long.groupBy("col", "value").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    return store(numbered(first, ["col"]).select("col", "value", "code", "n"), "codes")


def dictionary(codes: DataFrame) -> tuple[Callable[[str], Column], DataFrame | None]:
    """Codes of all columns in one hash table that is looked up by an expression (a scalar subquery, so nothing is joined): the
    code of a column's value, or null; and the codes that the table lacks, or None.

    It holds the values with most rows, ``DICTIONARY_VALUES`` at most, so what it lacks are rare values and very long ones.
    """
    top = codes.filter(F.octet_length("value") <= DICTIONARY_BYTES).orderBy(F.desc("n"), "col", "value").limit(DICTIONARY_VALUES)
    top, every = store(top, "dictionary"), codes.count()
    held = top.count()
    slots = 1 << max(0, held - 1).bit_length()
    entry = F.struct(key(F.col("col"), F.col("value")).alias("k"), F.col("code").alias("c"))
    own = top.groupBy(slot(F.col("col"), F.col("value"), slots).alias("slot")).agg(F.collect_list(entry).alias("e"))
    every_slot = codes.sparkSession.range(slots).join(own, F.col("id") == F.col("slot"), "left").agg(F.array_sort(F.collect_list(F.struct("id", "e"))).alias("all"))
    table = every_slot.select(F.transform("all", lambda x: F.map_from_entries(x["e"])).alias("d"))
    rest = None if held == every else store(codes.join(top.select("col", "value"), ["col", "value"], "left_anti"), "rare-codes")
    whole = table.scalar()
    return lambda c: F.try_element_at(F.get(whole, slot(F.lit(c), token(c), slots)), key(F.lit(c), token(c))), rest


def key(c: Column, value: Column) -> Column:
    return F.concat(c, F.lit("\x00"), value)


def slot(c: Column, value: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(c, value), F.lit(slots)).cast("int")


def encode_categories(df: DataFrame, codes: DataFrame, columns: list[str]) -> DataFrame:
    """``<column>_code`` for each column; values unknown to ``codes`` are -1."""
    return looked_up(df, codes, columns, "code", F.lit(-1))


def looked_up(df: DataFrame, codes: DataFrame, columns: list[str], name: str, unknown: Column) -> DataFrame:
    """``<column>_<name>`` from (col, value, code, n) for each column.

    Codes come from the dictionary. Only where values do not fit into it, rows are written with a number of their own,
    and what the dictionary did not know is looked up in one join of (column, value) and comes back in another; the values
    that most rows have are in the dictionary, so they are not shuffled.
    """
    found, rest = dictionary(codes.filter(F.col("col").isin(*columns)))
    made = {c: f"{c}_{name}" for c in columns}
    if rest is None:
        return df.withColumns({n: F.coalesce(found(c), unknown) for c, n in made.items()})
    late = [r[0] for r in rest.select("col").distinct().collect()]  # some of ``columns``
    rows = store(df.withColumns({n: found(c) for c, n in made.items()}).withColumn("_row", F.monotonically_increasing_id()), "encoded")
    asked = rows.select("_row", F.explode(F.array_compact(F.array(*[F.when(F.col(made[c]).isNull(), F.struct(F.lit(c).alias("col"), token(c).alias("value"))) for c in late]))).alias("e"))
    met = asked.select("_row", "e.*").join(rest, ["col", "value"]).groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("col", "code"))).alias("_late"))
    out = rows.join(met, "_row", "left")
    return out.withColumns({n: F.coalesce(F.col(n), *([F.try_element_at("_late", F.lit(c))] if c in late else []), unknown) for c, n in made.items()}).drop("_row", "_late")


def ordered_targets(df: DataFrame, columns: list[str], seed: int = 42, prior: float = 0.5, alpha: float = 1.0, parts: int | None = None) -> DataFrame:
    """``<column>_target`` for each column of labeled rows: the smoothed rate of positives among rows of the same value that
    come earlier in a random order, so a row's own label is never in its feature.

    The order is a keyed hash of ``event_id``; null is a value; rows that share an id follow in the order of their labels.
    Rows of a value are dealt by ranges of the order, so that a value of a third of all rows is spread. Labels are
    ``target`` 1 or 0; rows without one are left out.
    """
    rows = store(df.filter("target >= 0").withColumn("_row", F.monotonically_increasing_id()), "labeled")
    long = rows.select("_row", F.xxhash64(F.lit(seed), "event_id").alias("_order"), "event_id", F.col("target").alias("_y"), F.explode(long_values(columns)).alias("e")).select("*", "e.*").drop("e")
    t = deal(long, ["col", "value"], ["_order", "event_id", "_y", "_row"], parts).scan({"_n": total(F.lit(1), before=True), "_p": total((F.col("_y") == 1).cast("long"), before=True)})
    rate = smoothed(F.col("_p"), F.col("_n"), F.lit(prior), alpha)
    wide = t.rows.groupBy("_row").agg(*[F.max(F.when(F.col("col") == c, rate)).alias(f"{c}_target") for c in columns])
    return rows.join(wide, "_row").drop("_row")


def fit_targets(df: DataFrame, columns: list[str], prior: float = 0.5, alpha: float = 1.0) -> DataFrame:
    """(col, value, rate, n) over all labeled rows: what rows to score read. The table is stored."""
    long = df.filter("target >= 0").select("target", F.explode(long_values(columns)).alias("e")).select("target", "e.*")
    counted = long.groupBy("col", "value").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("target") == 1).alias("_p"))
    return store(counted.select("col", "value", smoothed(F.col("_p"), F.col("n"), F.lit(prior), alpha).alias("rate"), "n"), "targets")


def apply_targets(df: DataFrame, targets: DataFrame, columns: list[str], prior: float = 0.5) -> DataFrame:
    """``<column>_target`` of rows to score from frozen totals; a value that training never had is at the prior."""
    rates = targets.select("col", "value", F.col("rate").alias("code"), "n")
    return looked_up(df, rates, columns, "target", F.lit(prior))


def with_weights(df: DataFrame, reviewed_negative: float = 1.0, unlabeled: float = 0.01) -> DataFrame:
    """``y`` and ``weight``: red 1, yellow and unlabeled by their weights."""
    weight = F.when(F.col("target") == 1, 1.0).when(F.col("target") == 0, reviewed_negative).otherwise(unlabeled)
    return df.withColumns({"y": (F.col("target") == 1).cast("int"), "weight": weight})
