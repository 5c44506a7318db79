"""Compares queries with their SQL in DuckDB: sorted column names, then sorted rows."""

from __future__ import annotations

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(x):
    if x is None:
        return (0,)
    if isinstance(x, float):
        return (1, "nan" if math.isnan(x) else round(x, 7) + 0.0)
    return (1, str(x)) if not isinstance(x, (int, str)) else (1, x)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def difference(spark, duck, fn, sql: str, sf_dir: str) -> str:
    """Empty if both give the same rows."""
    df = fn(spark, sf_dir)
    got = df.collect()
    rel = duck.sql(sql)
    want, names = rel.fetchall(), list(rel.columns)
    if sorted(df.columns) != sorted(names):
        return f"columns {df.columns} and {names}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(wrong)} of {len(a)} rows, first {wrong[0]}" if wrong else ""
