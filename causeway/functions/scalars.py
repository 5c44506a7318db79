"""Scalar functions over canonical events; all are Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed word lists.
FALSY = ["0", "false", "none", "null", "<null>", "<na>", "nan"]
WEAK_SESSION = ["<null>", "null", "none", "nan", "unknown", "0", ""]
FINGERPRINT = ["operating_system_type", "device_system_version", "screen_size", "timezone", "accept_language", "browser_language"]
NULL = "<NULL>"
THIRTY_MINUTES = 1800
# Fixed edges of buckets.
AMOUNT_EDGES = [2.0, 6.0, 10.0, 14.0]
BATTERY_EDGES = [5.0, 20.0, 80.0, 100.0]


def event_time(c: str = "event_dttm") -> Column:
    """The event time, null where the text is none."""
    return F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd HH:mm:ss"))


def with_time(df: DataFrame, weekend: tuple[int, ...] = (5, 6)) -> DataFrame:
    """Calendar parts, epoch seconds and amounts. ``weekend``: ISO days (Monday 1) that count as weekend."""
    t = F.col("event_dt")
    iso = F.weekday(t) + 1
    amount = F.coalesce("operaton_amt", F.lit(0.0))
    return df.withColumn("event_dt", event_time()).withColumns({
        "week_start": F.to_date(F.date_trunc("week", t)), "event_date": F.to_date(t), "event_hour": F.hour(t), "event_weekday": iso,
        "event_day": F.dayofmonth(t), "event_week": F.weekofyear(t), "event_month": F.month(t), "is_weekend": iso.isin(*weekend).cast("int"),
        "event_ts": F.unix_timestamp(t), "operaton_amt": amount, "log_amt": F.log1p(amount), "is_zero_amt": (amount == 0).cast("int"),
    })


def cents(c: str = "operaton_amt") -> Column:
    """An amount in whole cents: sums are exact and do not depend on their order."""
    return F.round(F.coalesce(c, F.lit(0.0)) * 100).cast("long")


def token(c: str | Column) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(NULL))


def truthy(c: str) -> Column:
    return ~F.lower(token(c)).isin(*FALSY)


def fingerprint() -> Column:
    return F.concat_ws("|", *[token(c) for c in FINGERPRINT])


def language_pair() -> Column:
    return F.concat_ws("|", token("accept_language"), token("browser_language"))


def language_mismatch() -> Column:
    a, b = F.col("accept_language"), F.col("browser_language")
    return (a.isNotNull() & b.isNotNull() & (a != b)).cast("int")


def device_risk() -> Column:
    return (truthy("web_rdp_connection") | truthy("developer_tools") | truthy("compromised")).cast("int")


def weak_session(c: str = "session_id") -> Column:
    return F.lower(token(c)).isin(*WEAK_SESSION)


def session_key(fallback: bool = True) -> Column:
    """The session, or a 30-minute bucket of the customer where it is weak."""
    bucket = F.concat(F.lit("__30m__"), F.floor(F.col("event_ts") / THIRTY_MINUTES).cast("string"))
    return F.when(weak_session(), bucket).otherwise(token("session_id")) if fallback else token("session_id")


def right_closed(x: Column, edges: list[float]) -> Column:
    """0 up to the first edge (inclusive), and so on; -1 for null and NaN."""
    out = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        out = F.when(x <= edges[i], i).otherwise(out)
    return F.when(x.isNull() | F.isnan(x), -1).otherwise(out)


def amount_bucket() -> Column:
    """Bucket of the logarithm of the amount; -1 where it has none."""
    return right_closed(F.col("log_amt"), AMOUNT_EDGES)


def battery_level(c: str = "battery") -> Column:
    """The number in the text, or null; only plain decimal numbers count."""
    text = F.trim(F.col(c))
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def battery_bucket(level: Column) -> Column:
    return right_closed(level, BATTERY_EDGES)


def is_night() -> Column:
    return ((F.col("event_hour") <= 5) | (F.col("event_hour") >= 23)).cast("int")


def ratio(a: Column, b: Column) -> Column:
    """a / max(b, 1)."""
    return a / F.greatest(b, F.lit(1))


def sigmoid(x: Column, bound: float = 40.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(bound)), F.lit(-bound))))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def smoothed(pos: Column, cnt: Column, prior: Column, alpha: float) -> Column:
    return (pos + alpha * prior) / (cnt + alpha)


def tokenize(v: Column) -> Column:
    """Ids for a model: 0 pads, 1 unknown, 2 mask, values from 3."""
    return F.when(v >= 0, v + 3).otherwise(1)


def hour_token(ts: Column) -> Column:
    return F.pmod(F.floor(ts / 3600), F.lit(24)) + 1


def delta_log(delta: Column) -> Column:
    return F.log1p(F.least(F.greatest(delta, F.lit(0)), F.lit(2_592_000)).cast("double"))
