"""Frames in time that end at the current row: all earlier rows of a key at most W seconds back.

Rows of one second are ordered by a tie-breaker, and later ones of the same second do not count. A cap of N rows is the
shorter of two nested suffixes.

Nothing is aggregated anew for each row. Every row is dealt out once more for each window, W + 1 seconds later and before
all rows of that second, with the opposite sign: one running sum then gives counts and sums of all windows. Values that
cannot be taken back that way (maxima, sums under a cap, sums of columns that are made later) are met by the number of the
frame's first row: a sum is the difference of two running sums; a maximum is put together from two blocks of W + 1 seconds
(or of N rows), the running maximum of the row's own block and that of the block before it from its end backwards. All are
scans over range partitions, so time is in proportion to the rows and a key with very many rows is spread.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.operators.ordered import Ranges, deal, most, total
from causeway.sources.sinks import store


@dataclass(frozen=True)
class Timeline(Ranges):
    """Entries by key, time and tie-breaker. ``_rn``: a row's number in its key; ``_n_W``: rows of its frame of W seconds;
    ``_s_x_W``: the sum of measure ``x`` in it."""

    ts: str = "event_ts"

    def count(self, seconds: int, cap: int | None = None) -> Column:
        n = F.col(f"_n_{seconds}")
        return n if cap is None else F.least(n, F.lit(cap))

    def fetch(self, at: Column, columns: dict[str, str]) -> Timeline:
        """Columns of the row of the same key whose number is ``at``. Only these columns are written; they are unique by key
        and number, so no partition of the join is larger than others."""
        key = self.keys[0]
        other = self.rows.select(F.col(key).alias("_fk"), F.col("_rn").alias("_fi"), *[F.col(c).alias(n) for n, c in columns.items()])
        other = store(other, "numbered")
        rows = self.rows.withColumn("_at", at).join(other, F.col(key).eqNullSafe(F.col("_fk")) & (F.col("_at") == F.col("_fi")), "left")
        return replace(self, rows=rows.drop("_at", "_fk", "_fi"))

    def over(self, seconds: int, sums: dict[str, str] | None = None, maxima: dict[str, str] | None = None, cap: int | None = None) -> Timeline:
        """Adds sums and maxima of columns over the frame, by the name of the result."""
        sums, maxima = sums or {}, maxima or {}
        plain = {n: c for n, c in sums.items() if cap is None and f"_s_{c}_{seconds}" in self.rows.columns}
        out, rest = self.with_columns_of({n: F.col(f"_s_{c}_{seconds}") for n, c in plain.items()}), {n: c for n, c in sums.items() if n not in plain}
        if not rest and not maxima:
            return out
        numbers = {c: f"{i}_{seconds}" for i, c in enumerate(dict.fromkeys([*rest.values(), *maxima.values()]))}
        wanted = {}
        if rest:
            out = out.scan({f"_p{numbers[c]}": total(F.col(c), lasts=False) for c in dict.fromkeys(rest.values())})
            wanted |= {f"_fp{numbers[c]}": f"_p{numbers[c]}" for c in rest.values()} | {f"_fx{numbers[c]}": c for c in rest.values()}
        if maxima:
            blocks = {"_b": F.floor(F.col(self.ts) / (seconds + 1))} | ({} if cap is None else {"_r": F.floor((F.col("_rn") - 1) / cap)})
            out, of = out.with_columns(blocks), dict.fromkeys(maxima.values())
            for b in blocks:
                out = out.scan({f"{b}u{numbers[c]}": most(F.col(c), lasts=False) for c in of}, (b,)).scan({f"{b}d{numbers[c]}": most(F.col(c), lasts=False) for c in of}, (b,), reverse=True)
                wanted |= {f"_f{b}d{numbers[c]}": f"{b}d{numbers[c]}" for c in of}
            wanted["_fb"] = "_b"
        out = out.fetch(F.col("_rn") - self.count(seconds, cap) + 1, wanted)
        made = {n: F.col(f"_p{numbers[c]}") - F.col(f"_fp{numbers[c]}") + F.coalesce(f"_fx{numbers[c]}", F.lit(0)) for n, c in rest.items()}
        for n, c in maxima.items():
            k = numbers[c]
            # A frame that begins in the row's own block holds all of it up to the row.
            by_time = F.greatest(f"_bu{k}", F.when(F.col("_fb") < F.col("_b"), F.col(f"_f_bd{k}")))
            by_rows = None if cap is None else F.greatest(f"_ru{k}", f"_f_rd{k}")
            made[n] = by_time if by_rows is None else F.when(F.col(f"_n_{seconds}") <= cap, by_time).otherwise(by_rows)
        out, kept = out.with_columns_of(made), {*self.rows.columns, *sums, *maxima}
        return out.each(lambda df: df.drop(*[c for c in df.columns if c not in kept]))

    def with_columns_of(self, made: dict[str, Column]) -> Timeline:
        """Columns of the rows alone, which no later scan may use."""
        return replace(self, rows=self.rows.withColumns(made))


def timeline(
    df: DataFrame, windows: dict[int, tuple[str, ...]], measures: dict[str, Column] | None = None, key: str = "customer_id", ts: str = "event_ts", tie: str = "event_id", parts: int | None = None,
    past: dict[str, DataFrame] | None = None, log: list | None = None,
) -> Timeline:
    """Deals ``df`` for frames of the given seconds, each with the measures that are summed up in it.

    Rows without a time are left out; null keys are one key. Measures become columns; whole numbers keep sums exact.
    ``past`` and ``log`` are those of ``Ranges``; frames only reach rows that are here.
    """
    measures = measures or {}
    rows = df.filter(F.col(ts).isNotNull()).withColumns({**measures, "_t": F.col(ts).cast("long"), "_k": F.lit(1), "_w": F.lit(None).cast("int")})
    if windows:
        # Kind 0, expiry, comes before kind 1, entry. Expiries only keep key and measures.
        kind = lambda k, w, t: F.struct(F.lit(k).alias("k"), F.lit(w).cast("int").alias("w"), t.alias("t"))
        kinds = [kind(1, None, F.col("_t")), *[kind(0, w, F.col("_t") + w + 1) for w in windows]]
        rows = rows.withColumn("_e", F.explode(F.array(*kinds)))
        slim = lambda c: F.col(c) if c == key or c in measures else F.when(F.col("_e.k") == 1, F.col(c)).alias(c)
        rows = rows.select(*[slim(c) for c in rows.columns if c not in ("_e", "_t", "_k", "_w")], F.col("_e.t").alias("_t"), F.col("_e.k").alias("_k"), F.col("_e.w").alias("_w"))
    dealt = replace(deal(rows, [key], ["_t", "_k", tie], parts), past=past, log=log)
    entry = F.col("_k") == 1
    signed = lambda x, w: F.when(entry, x).when(F.col("_w") == w, -x).otherwise(0)
    made = {"_rn": total(F.when(entry, F.lit(1).cast("long")).otherwise(0))} | {f"_n_{w}": total(signed(F.lit(1), w), lasts=False) for w in windows}
    made |= {f"_s_{c}_{w}": total(signed(F.col(c), w), lasts=False) for w, cs in windows.items() for c in cs}
    out = dealt.scan(made, deep=True).each(lambda x: x.filter(entry).drop("_k", "_w", "_t"))
    return Timeline(out.rows, out.edge, (key,), (ts, tie), past, log, ts)
