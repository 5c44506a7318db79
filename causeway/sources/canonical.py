"""The canonical event relation, its fixture adapter, and the frames that training and evaluation read.

Canonical events have one row per operation with the columns of ``COLUMNS`` and a tri-state ``target`` (1 red, 0 yellow,
-1 unlabeled). The fixture tables lack most of them; ``events`` derives them deterministically.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed names of the event columns, in order.
COLUMNS = [
    "customer_id", "event_id", "event_dttm", "event_type_nm", "event_desc", "channel_indicator_type", "channel_indicator_sub_type",
    "operaton_amt", "currency_iso_cd", "mcc_code", "pos_cd", "accept_language", "browser_language", "timezone", "session_id",
    "operating_system_type", "battery", "device_system_version", "screen_size", "developer_tools", "phone_voip_call_state",
    "web_rdp_connection", "compromised",
]
#: The fixture's derivation: column, Spark expression. ``k`` is the number in ``props``.
DERIVED = [
    ("customer_id", "user_id"),
    ("event_id", "event_id"),
    ("event_dttm", "date_format(ts, 'yyyy-MM-dd HH:mm:ss')"),
    ("event_type_nm", "case event_type when 'click' then 0 when 'view' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end"),
    ("event_desc", "k"),
    ("channel_indicator_type", "k % 2"),
    ("channel_indicator_sub_type", "k % 4"),
    ("operaton_amt", "case when k % 10 = 0 then null else value end"),
    ("currency_iso_cd", "643"),
    ("mcc_code", "case when k % 7 = 0 then null else cast(k % 12 as string) end"),
    ("pos_cd", "k % 3"),
    ("accept_language", "case when k % 3 = 0 then 'ru' when k % 3 = 1 then 'en' else null end"),
    ("browser_language", "case when k % 4 = 0 then 'en' when k % 4 = 3 then null else 'ru' end"),
    ("timezone", "cast(180 + 60 * (k % 3) as string)"),
    ("session_id", "case when event_id % 5 = 0 then null when event_id % 5 = 1 then 'unknown' else concat(cast(user_id as string), '-', date_format(ts, 'yyyy-MM-dd')) end"),
    ("operating_system_type", "cast(user_id % 3 as string)"),
    ("battery", "case when event_id % 11 = 0 then 'n/a' when event_id % 13 = 0 then null else cast(k as string) end"),
    ("device_system_version", "cast(10 + k % 2 as string)"),
    ("screen_size", "'1080x2400'"),
    ("developer_tools", "case when k % 25 = 0 then '1' else '0' end"),
    ("phone_voip_call_state", "cast(null as string)"),
    ("web_rdp_connection", "case when k % 33 = 0 then 'true' else 'false' end"),
    ("compromised", "case when k % 49 = 0 then '1' else null end"),
    ("target", "case when event_type = 'error' and k < 50 then 1 when event_type = 'signup' then 0 else -1 end"),
]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical events of the fixture, with ``target``."""
    return derived(spark.read.parquet(f"{sf_dir}/events.parquet"))


def derived(raw: DataFrame) -> DataFrame:
    """Canonical events from rows of the fixture's table, read or streamed."""
    base = raw.select("event_id", "user_id", "ts", "event_type", "value", F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"))
    return base.selectExpr(*[f"{e} as {c}" for c, e in DERIVED])


def scan(spark: SparkSession, paths: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """Parquet files or globs, in a fixed projection (only these columns are read)."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    return df.select(*columns) if columns else df


def discover(spark: SparkSession, folder: str, patterns: list[str]) -> DataFrame:
    """One relation of the files in ``folder`` that match any pattern; patterns without files are left out.

    Listing goes through Spark's file system, so any store works.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found: list[str] = []
    for p in patterns:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{p}")
        found += sorted(str(s.getPath()) for s in (path.getFileSystem(conf).globStatus(path) or []))
    if not found:
        raise FileNotFoundError(f"no file in {folder} matches {patterns}")
    return spark.read.parquet(*dict.fromkeys(found))


def labels(canon: DataFrame) -> DataFrame:
    """The label table (event_id, target) that goes with ``canon``."""
    return canon.filter("target >= 0").select("event_id", "target")


def rest(canon: DataFrame) -> list[str]:
    return [c for c in canon.columns if c not in ("event_id", "target")]


def limited(df: DataFrame, rows: int | None) -> DataFrame:
    """The first ``rows`` rows by event_id; all if None."""
    return df if rows is None else df.orderBy("event_id").limit(rows)


def labeled_frame(canon: DataFrame, label: DataFrame, rows: int | None = None) -> DataFrame:
    """Every label with its event; labels without an event stay, with nulls."""
    events_ = canon.drop("target")
    return limited(label.join(events_, "event_id", "left").select("event_id", "target", *rest(canon)), rows)


def unlabeled_sample(canon: DataFrame, label: DataFrame, modulo: int = 1000, rows: int | None = None) -> DataFrame:
    """Events without a label whose id is divisible by ``modulo``, as target -1."""
    some = canon.drop("target").filter(F.col("event_id") % modulo == 0)
    out = some.join(label.select("event_id"), "event_id", "left_anti").withColumn("target", F.lit(-1))
    return limited(out.select("event_id", "target", *rest(canon)), rows)


def train_frame(canon: DataFrame, label: DataFrame, modulo: int = 1000, labeled_rows: int | None = None, unlabeled_rows: int | None = None) -> DataFrame:
    return labeled_frame(canon, label, labeled_rows).unionByName(unlabeled_sample(canon, label, modulo, unlabeled_rows))


def week_frame(canon: DataFrame, label: DataFrame, week: dt.date, rows: int | None = None) -> DataFrame:
    """All events of the week that begins on ``week`` with their labels, -1 if none.

    The week is a half-open range of the event time's text, which sorts like the time and can be pushed to the scan.
    """
    lo, hi = (f"{d:%Y-%m-%d} 00:00:00" for d in (week, week + dt.timedelta(7)))
    own = canon.drop("target").filter((F.col("event_dttm") >= lo) & (F.col("event_dttm") < hi))
    out = own.join(label, "event_id", "left").withColumn("target", F.coalesce("target", F.lit(-1)))
    return limited(out.select("event_id", "target", *rest(canon)), rows)


def test_frame(canon: DataFrame, rows: int | None = None) -> DataFrame:
    return limited(canon.drop("target"), rows)
