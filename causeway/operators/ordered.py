"""Ordered scans over range partitions: running and previous values of a key's rows, without a task that sees all of them.

Rows are dealt by ranges of (keys, order) and written once, as Spark draws the ranges from a sample. The rows of a key in a
range are a piece. A scan runs inside each piece and goes on from what the key's earlier pieces leave: sums, maxima, last
and first values combine associatively. Only keys that reach over the end of a range have several pieces, so what is
carried holds at most two rows for each range, or for a scan by further columns a row for each of their values there.

What all rows leave is a table for each scan. Given as ``past``, it stands before the rows as an earlier piece of every key,
so rows that are gone need not be read again.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.sources.sinks import store


@dataclass(frozen=True)
class Scan:
    """``how``: sum, max, previous or first. ``before``: without the row itself (sum, max). ``lasts``: whether what rows leave
    matters to later runs."""

    how: str
    value: Column
    before: bool = False
    lasts: bool = True

    def left(self, at: Column) -> Column:
        """The aggregate of a piece's rows; ``at`` is their order."""
        if self.how in ("sum", "max"):
            return (F.sum if self.how == "sum" else F.max)(self.value)
        return (F.max if self.how == "previous" else F.min)(F.struct(at.alias("at"), self.value.alias("v")))

    def merged(self, c: str) -> Column:
        """The aggregate of several pieces' aggregates."""
        return {"sum": F.sum, "max": F.max, "previous": F.max, "first": F.min}[self.how](c)


def total(x: Column, before: bool = False, lasts: bool = True) -> Scan:
    return Scan("sum", x, before, lasts)


def most(x: Column, before: bool = False, lasts: bool = True) -> Scan:
    return Scan("max", x, before, lasts)


def previous(x: Column) -> Scan:
    return Scan("previous", x)


def first(x: Column) -> Scan:
    return Scan("first", x)


def same(pairs: list[tuple[str, str]]) -> Column:
    """Equality of columns where null is a value."""
    out = F.lit(True)
    for a, b in pairs:
        out &= F.col(a).eqNullSafe(F.col(b))
    return out


@dataclass(frozen=True)
class Ranges:
    """Rows with ``_part``, the range that each is in. ``edge``: the rows of keys with several pieces; None if there are none.

    ``past``: by the name of a scan, what earlier rows left. ``log``: gets (name, group, scans, rows) of each scan.
    """

    rows: DataFrame
    edge: DataFrame | None
    keys: tuple[str, ...]
    order: tuple[str | Column, ...]
    past: dict[str, DataFrame] | None = None
    log: list | None = None

    def each(self, change) -> Ranges:
        """``change`` applied to all rows; it may only look at one row at a time."""
        return replace(self, rows=change(self.rows), edge=None if self.edge is None else change(self.edge))

    def with_columns(self, made: dict[str, Column]) -> Ranges:
        return self.each(lambda df: df.withColumns(made))

    def scan(self, made: dict[str, Scan], by: tuple[str, ...] = (), reverse: bool = False, deep: bool = False) -> Ranges:
        """Adds scanned columns, of each key or each value of ``by`` inside it; ``reverse``: from the last row backwards.

        Values may use columns of earlier scans only if those were ``deep``, which keeps the edge rows in step.
        """
        carry = None if self.edge is None else self._carry(made, by, reverse)
        name, lasting = "-".join(["_".join(by) or "all", *made]), {n: s for n, s in made.items() if s.lasts}
        if self.log is not None and lasting:
            self.log.append((name, [*self.keys, *by], lasting, self.rows))
        past = (self.past or {}).get(name)
        rows = self._scanned(self.rows, carry, past, made, by, reverse)
        return replace(self, rows=rows, edge=self._scanned(self.edge, carry, past, made, by, reverse) if deep and carry is not None else self.edge)

    def _order(self, reverse: bool) -> list:
        return [F.desc(c) for c in self.order] if reverse else list(self.order)

    def _carry(self, made: dict[str, Scan], by: tuple[str, ...], reverse: bool) -> DataFrame:
        """What the earlier pieces leave for each piece; stored, so that it is made once and plans stay small."""
        group, at = [*self.keys, *by], F.struct(*self.order)
        pieces = self.edge.groupBy("_part", *group).agg(*[s.left(at).alias(f"_t_{n}") for n, s in made.items()])
        w = Window.partitionBy(*group).orderBy(F.desc("_part") if reverse else F.asc("_part")).rowsBetween(Window.unboundedPreceding, -1)
        out = pieces.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], *[s.merged(f"_t_{n}").over(w).alias(f"_c_{n}") for n, s in made.items()])
        out = store(out, "carry")
        return out if by else F.broadcast(out)  # without ``by`` at most two rows for each range

    def _scanned(self, rows: DataFrame, carry: DataFrame | None, past: DataFrame | None, made: dict[str, Scan], by: tuple[str, ...], reverse: bool) -> DataFrame:
        group, columns = [*self.keys, *by], rows.columns
        w = Window.partitionBy("_part", *group).orderBy(*self._order(reverse))
        upto, earlier = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
        if carry is not None:
            rows = rows.join(carry, same([("_part", "_p"), *[(c, f"_g{i}") for i, c in enumerate(group)]]), "left")
        if past is not None:
            renamed = past.select(*[F.col(c).alias(f"_h{i}") for i, c in enumerate(group)], *[F.col(n).alias(f"_q_{n}") for n in past.columns if n in made])
            rows = rows.join(renamed, same([(c, f"_h{i}") for i, c in enumerate(group)]), "left")

        def value(n: str, s: Scan) -> Column:
            before = [F.col(c) for c in (f"_c_{n}", f"_q_{n}") if c in rows.columns]  # the nearer pieces first
            near = earlier if s.before else upto
            if s.how == "sum":
                return reduce(lambda a, b: a + F.coalesce(b, F.lit(0)), before, F.coalesce(F.sum(s.value).over(near), F.lit(0)))
            if s.how == "max":
                x = F.max(s.value).over(near)
                return F.greatest(x, *before) if before else x
            if s.how == "previous":
                x = F.lag(s.value).over(w)
                return F.when(F.row_number().over(w) == 1, F.coalesce(*before)["v"]).otherwise(x) if before else x
            own = F.first(F.struct(F.struct(*self.order).alias("at"), s.value.alias("v"))).over(upto)
            return F.coalesce(*before[::-1], own)["v"] if before else own["v"]

        return rows.withColumns({n: value(n, s) for n, s in made.items()}).select(*columns, *[n for n in made if n not in columns])

    def result(self) -> DataFrame:
        """The rows without internal columns."""
        return self.rows.drop(*[c for c in self.rows.columns if c.startswith("_")])


def deal(df: DataFrame, keys: list[str], order: list[str | Column], parts: int | None = None) -> Ranges:
    """``df`` dealt by ranges of keys and order; no keys: one order of all rows. ``parts``: so many ranges, else as Spark's
    settings and the amount of data say."""
    if not keys:
        df, keys = df.withColumn("_all", F.lit(0)), ["_all"]
    by = [*keys, *order]
    dealt = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    rows = store(dealt.withColumn("_part", F.spark_partition_id()), "ranged")
    key = F.struct(*keys)
    ends = rows.groupBy("_part").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))  # a row for each range
    ends = ends.withColumn("before", F.lag("hi").over(Window.orderBy("_part")))
    split = store(ends.filter(F.col("lo").eqNullSafe(F.col("before"))).select(*[F.col(f"lo.{k}").alias(f"_k{i}") for i, k in enumerate(keys)]).distinct(), "split")
    edge = None if split.isEmpty() else rows.join(F.broadcast(split), same([(k, f"_k{i}") for i, k in enumerate(keys)]), "left_semi")
    return Ranges(rows, edge, tuple(keys), tuple(order))


def leave(log: list, order: list[str], past: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """By the name of each scan, what the rows of a run leave to later ones, on top of what came before them."""
    out = {}
    for name, group, scans, rows in log:
        own = rows.groupBy(*group).agg(*[s.left(F.struct(*order)).alias(n) for n, s in scans.items()])
        if past is not None:
            both = own.unionByName(past[name].select(own.columns))
            own = both.groupBy(*group).agg(*[s.merged(n).alias(n) for n, s in scans.items()])
        out[name] = own
    return out


def running(df: DataFrame, keys: list[str], order: list[str | Column], sums: dict[str, str]) -> DataFrame:
    """``df`` with, for each (name, column) of ``sums``, the sum over its group up to and with each row, in ``order``."""
    out = deal(df, keys, order).scan({n: total(F.col(c)) for n, c in sums.items()}).rows
    return out.drop("_part") if keys else out.drop("_part", "_all")
