"""One query for each operator over the given tables, and DuckDB SQL for the same rows.

A query is declared with the types of its result: l long, f double, r double rounded to 8 places, s text, d date.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions import scalars as S
from causeway.operators import encode, prefix, profile, risk, sequences
from causeway.operators.frames import Timeline, timeline
from causeway.plans import evaluation as E
from causeway.sources import canonical as C
from causeway.streaming import events as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TYPES = {"l": ("bigint", "bigint"), "f": ("double", "double"), "r": ("double", "double"), "s": ("string", "varchar"), "d": ("date", "date")}
WEEK3, WEEK4 = dt.date(2024, 1, 15), dt.date(2024, 1, 22)
MODULO, FOLDS, TRAIN_WEEKS = 10, 2, 3


def query(name: str, spec: str, sql: str | None):
    """Registers a function (spark, sf_dir) and its SQL; both results get the types of ``spec``."""
    columns = [x.split(":") for x in spec.split()]

    def cast(c: str, t: str, k: int) -> str:
        x = f"cast({c} as {TYPES[t][k]})"
        return f"round({x}, 8)" if t == "r" else x

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir).selectExpr(*[f"{cast(c, t, 0)} as {c}" for c, t in columns])

        QUERIES[name] = run
        if sql:
            ORACLE[name] = f"with {CANON}, q as ({sql}) select {', '.join(f'{cast(c, t, 1)} as {c}' for c, t in columns)} from q"
        return fn

    return register


def _duck(e: str) -> str:
    return e.replace("as string", "as varchar").replace("date_format(ts, 'yyyy-MM-dd HH:mm:ss')", "strftime(ts, '%Y-%m-%d %H:%M:%S')").replace("date_format(ts, 'yyyy-MM-dd')", "strftime(ts, '%Y-%m-%d')")


_T = lambda c: f"coalesce(cast({c} as varchar), '<NULL>')"
_FP = " || '|' || ".join(_T(c) for c in S.FINGERPRINT)
_LP = f"{_T('accept_language')} || '|' || {_T('browser_language')}"
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_RISK = "cast((" + " or ".join(f"lower({_T(c)}) not in {_IN(S.FALSY)}" for c in ("web_rdp_connection", "developer_tools", "compromised")) + ") as int)"
_LM = "cast(coalesce(accept_language <> browser_language, false) as int)"
_WEAK = f"lower({_T('session_id')}) in {_IN(S.WEAK_SESSION)}"
CANON = f"""
b as (select event_id, user_id, ts, event_type, value, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from events),
canon as (select {", ".join(f"{_duck(e)} as {c}" for c, e in C.DERIVED)} from b),
p as (select *, try_strptime(event_dttm, '%Y-%m-%d %H:%M:%S') as event_dt from canon),
ev as (select * exclude (operaton_amt), coalesce(operaton_amt, 0.0) as operaton_amt, operaton_amt as raw_amt, cast(date_trunc('week', event_dt) as date) as week_start,
 cast(event_dt as date) as event_date, hour(event_dt) as event_hour, isodow(event_dt) as event_weekday, cast(epoch(event_dt) as bigint) as event_ts,
 cast(round(coalesce(operaton_amt, 0.0) * 100) as bigint) as cents, (event_desc * 7 + channel_indicator_sub_type * 13) % 50 / 50.0::double as score,
 {_FP} as fp, {_LP} as lp, case when {_WEAK} then '__30m__' || cast(event_ts // 1800 as varchar) else {_T("session_id")} end as session_key from p),
lab as (select event_id, target from canon where target >= 0)"""
EVENT = "event_id:l customer_id:l event_dttm:s event_type_nm:l operaton_amt:f mcc_code:s session_id:s"
K = "partition by customer_id order by event_ts, event_id"


def canon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.events(spark, sf_dir)


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_time(canon(spark, sf_dir))


def ready(spark: SparkSession, sf_dir: str, windows: dict | None = None) -> Timeline:
    return prefix.timeline(timed(spark, sf_dir), windows)


def scored(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.expr("(event_desc * 7 + channel_indicator_sub_type * 13) % 50 / 50.0D"))


def _cnt(w: int, key="customer_id", ts="event_ts", tie="event_id") -> str:
    return f"(count(*) over (partition by {key} order by {ts} range between {w} preceding and 1 preceding) + count(*) over (partition by {key}, {ts} order by {tie} rows unbounded preceding))"


def _sum(x: str, w: int, key="customer_id", ts="event_ts", tie="event_id") -> str:
    return f"(coalesce(sum({x}) over (partition by {key} order by {ts} range between {w} preceding and 1 preceding), 0) + sum({x}) over (partition by {key}, {ts} order by {tie} rows unbounded preceding))"


def _max(x: str, w: int, key="customer_id", ts="event_ts", tie="event_id") -> str:
    return f"greatest(max({x}) over (partition by {key} order by {ts} range between {w} preceding and 1 preceding), max({x}) over (partition by {key}, {ts} order by {tie} rows unbounded preceding))"


# Scans, frames, scalars


@query("time_amount_features", "event_id:l week_start:d event_hour:l event_weekday:l event_day:l event_week:l event_month:l is_weekend:l event_ts:l operaton_amt:f log_amt:r is_zero_amt:l amount_bucket:l is_night:l",
       """select *, day(event_dt) as event_day, week(event_dt) as event_week, month(event_dt) as event_month, cast(event_weekday in (5, 6) as int) as is_weekend, ln(1 + operaton_amt) as log_amt,
       cast(operaton_amt = 0 as int) as is_zero_amt, case when ln(1 + operaton_amt) <= 2 then 0 when ln(1 + operaton_amt) <= 6 then 1 when ln(1 + operaton_amt) <= 10 then 2 when ln(1 + operaton_amt) <= 14 then 3 else 4 end as amount_bucket,
       cast(event_hour <= 5 or event_hour >= 23 as int) as is_night from ev""")  # fmt: skip
def _(spark, sf):
    return timed(spark, sf).withColumns({"amount_bucket": S.amount_bucket(), "is_night": S.is_night()})


@query("labeled_frame", EVENT + " target:l", "select l.event_id, l.target, c.* exclude (event_id, target) from lab l left join canon c using (event_id)")
def _(spark, sf):
    c = canon(spark, sf)
    return C.labeled_frame(c, C.labels(c))


_UNLABELED = f"select * replace (-1 as target) from canon where event_id % {MODULO} = 0 and event_id not in (select event_id from lab)"


@query("unlabeled_sample", EVENT + " target:l", _UNLABELED)
def _(spark, sf):
    c = canon(spark, sf)
    return C.unlabeled_sample(c, C.labels(c), MODULO)


@query("train_frame", EVENT + " target:l", f"select c.* from lab join canon c using (event_id) union all {_UNLABELED}")
def _(spark, sf):
    c = canon(spark, sf)
    return C.train_frame(c, C.labels(c), MODULO)


@query("week_frame_full", EVENT + " target:l", f"select * from canon where event_dttm >= '{WEEK3} 00:00:00' and event_dttm < '{WEEK4} 00:00:00'")
def _(spark, sf):
    c = canon(spark, sf)
    return C.week_frame(c, C.labels(c), WEEK3)


@query("test_frame_limited", EVENT, "select * from canon order by event_id limit 500")
def _(spark, sf):
    return C.test_frame(canon(spark, sf), 500)


@query("valid_rows", "event_id:l customer_id:l event_ts:l", "select * from ev where customer_id is not null and event_id is not null and event_ts is not null")
def _(spark, sf):
    return timed(spark, sf).dropna(subset=["customer_id", "event_id", "event_ts"])


@query("device_flags", "event_id:l device_fingerprint:s rdp_or_root_flag:l lang_mismatch_flag:l language_pair:s weak_session:l session_key:s",
       f"select event_id, fp as device_fingerprint, {_RISK} as rdp_or_root_flag, {_LM} as lang_mismatch_flag, lp as language_pair, cast({_WEAK} as int) as weak_session, session_key from ev")
def _(spark, sf):
    return timed(spark, sf).withColumns({
        "device_fingerprint": S.fingerprint(), "rdp_or_root_flag": S.device_risk(), "lang_mismatch_flag": S.language_mismatch(),
        "language_pair": S.language_pair(), "weak_session": S.weak_session().cast("int"), "session_key": S.session_key(),
    })


# Windows that end at the row


@query("rolling_counts", "event_id:l customer_id:l rolling_count_10m:l rolling_count_1h:l rolling_count_1d:l rolling_count_7d:l dt_since_prev_sec:l is_new_mcc:l",
       f"""select event_id, customer_id, {_cnt(600)} as rolling_count_10m, {_cnt(3600)} as rolling_count_1h, {_cnt(86400)} as rolling_count_1d, {_cnt(604800)} as rolling_count_7d,
       coalesce(event_ts - lag(event_ts) over ({K}), 0) as dt_since_prev_sec, cast(row_number() over (partition by customer_id, mcc_code order by event_ts, event_id) = 1 as int) as is_new_mcc from ev""")  # fmt: skip
def _(spark, sf):
    return prefix.rolling(prefix.first_seen(prefix.gaps(ready(spark, sf, prefix.ROLLING)))).result()


@query("rolling_amounts", "event_id:l sum_amt_1d:f sum_amt_7d:f mean_amt_7d:f max_amt_7d:f",
       f"""select event_id, {_sum("cents", 86400)}::bigint / 100::double as sum_amt_1d, {_sum("cents", 604800)}::bigint / 100::double as sum_amt_7d,
       {_sum("cents", 604800)}::bigint / 100::double / greatest({_cnt(604800)}, 1) as mean_amt_7d, {_max("cents", 604800)} / 100::double as max_amt_7d from ev""")  # fmt: skip
def _(spark, sf):
    return prefix.rolling(ready(spark, sf, prefix.ROLLING)).result()


@query("rolling_burst", "event_id:l burst_10m_over_1h:f burst_1h_over_1d:f rolling_count_1m:l rolling_count_5m:l rolling_count_30m:l sum_amt_5m:f burst_5m_over_1d:f",
       f"""select event_id, {_cnt(600)} / {_cnt(3600)}::double as burst_10m_over_1h, {_cnt(3600)} / {_cnt(86400)}::double as burst_1h_over_1d, {_cnt(60)} as rolling_count_1m, {_cnt(300)} as rolling_count_5m,
       {_cnt(1800)} as rolling_count_30m, {_sum("cents", 300)}::bigint / 100::double as sum_amt_5m, {_cnt(300)} / {_cnt(86400)}::double as burst_5m_over_1d from ev""")  # fmt: skip
def _(spark, sf):
    return prefix.rolling(ready(spark, sf, prefix.ROLLING | prefix.ULTRA_BURST), ultra_burst=True).result()


MONTH = 30 * 86_400


def _capped(n: int) -> None:
    c, last = _cnt(MONTH), f"over ({K} rows between {n - 1} preceding and current row)"
    sql = f"""select event_id, least({c}, {n}) as cnt, case when {c} <= {n} then {_sum("cents", MONTH)} else sum(cents) {last} end::bigint as sum_cents,
    case when {c} <= {n} then {_max("cents", MONTH)} else max(cents) {last} end as max_cents, cast({c} > {n} as int) as bound from ev"""

    @query(f"rolling_capped_{n}", "event_id:l cnt:l sum_cents:l max_cents:l bound:l", sql)
    def _(spark, sf):
        t = ready(spark, sf, {MONTH: ()})
        return t.over(MONTH, {"sum_cents": "_cents"}, {"max_cents": "_cents"}, n).with_columns_of({"cnt": t.count(MONTH, n), "bound": (t.count(MONTH) > n).cast("int")}).result()


for _n in (5, 20, 100):
    _capped(_n)

_TIE = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]


@query("rolling_ties_lineitem", "l_suppkey:l l_orderkey:l l_linenumber:l l_partkey:l day_no:l cnt_30d:l sum_cents_30d:l max_cents_30d:l",
       f"""select *, {_cnt(30, "l_suppkey", "day_no", ", ".join(_TIE))} as cnt_30d, {_sum("x", 30, "l_suppkey", "day_no", ", ".join(_TIE))}::bigint as sum_cents_30d,
       {_max("x", 30, "l_suppkey", "day_no", ", ".join(_TIE))} as max_cents_30d from (select *, date_diff('day', timestamp '1970-01-01', l_shipdate) as day_no, cast(round(l_extendedprice * 100) as bigint) as x from lineitem)""")  # fmt: skip
def _(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").withColumns({"day_no": F.expr("cast(unix_date(cast(l_shipdate as date)) as bigint)"), "tie": F.struct(*_TIE)})
    t = timeline(rows, {30: ("x",)}, {"x": F.round(F.col("l_extendedprice") * 100).cast("long")}, "l_suppkey", "day_no", "tie")
    return t.over(30, {"sum_cents_30d": "x"}, {"max_cents_30d": "x"}).with_columns_of({"cnt_30d": t.count(30)}).result()


@query("baseline_pack", "event_id:l rolling_count_1h:l rolling_count_1d:l rolling_count_7d:l burst_1h_over_1d:r seq_customer_idx:l is_new_event_type:l amt_over_prev_mean:r",
       f"""select event_id, {_cnt(3600)} as rolling_count_1h, {_cnt(86400)} as rolling_count_1d, {_cnt(604800)} as rolling_count_7d, {_cnt(3600)} / ({_cnt(86400)} + 1e-6) as burst_1h_over_1d,
       row_number() over ({K}) - 1 as seq_customer_idx, cast(row_number() over (partition by customer_id, event_type_nm order by event_ts, event_id) = 1 as int) as is_new_event_type,
       operaton_amt / (coalesce(sum(cents) over ({K} rows between unbounded preceding and 1 preceding)::double / count(*) over ({K} rows between unbounded preceding and 1 preceding) / 100, 0) + 1) as amt_over_prev_mean from ev""")  # fmt: skip
def _(spark, sf):
    return prefix.baseline_pack(timed(spark, sf))


@query("gap_features", "event_id:l seq_customer_idx:l dt_since_prev_sec:l dt_since_prev_same_channel_sec:l dt_since_prev_same_mcc_sec:l time_since_last_seen_mcc_sec:l",
       f"""select event_id, row_number() over ({K}) - 1 as seq_customer_idx, coalesce(event_ts - lag(event_ts) over ({K}), 0) as dt_since_prev_sec,
       coalesce(event_ts - lag(event_ts) over (partition by customer_id, channel_indicator_sub_type order by event_ts, event_id), -1) as dt_since_prev_same_channel_sec,
       coalesce(event_ts - lag(event_ts) over (partition by customer_id, mcc_code order by event_ts, event_id), -1) as dt_since_prev_same_mcc_sec, dt_since_prev_same_mcc_sec as time_since_last_seen_mcc_sec from ev""")  # fmt: skip
def _(spark, sf):
    return prefix.gaps(ready(spark, sf)).result()


@query("novelty_flags", "event_id:l is_new_event_type:l is_new_mcc:l is_new_channel:l",
       "select event_id, " + ", ".join(f"cast(row_number() over (partition by customer_id, {c} order by event_ts, event_id) = 1 as int) as is_new_{n}" for c, n in (("event_type_nm", "event_type"), ("mcc_code", "mcc"), ("channel_indicator_sub_type", "channel"))) + " from ev")
def _(spark, sf):
    return prefix.first_seen(ready(spark, sf)).result()


@query("fingerprint_history", "event_id:l is_new_device_for_customer:l is_new_fingerprint_for_customer:l fingerprint_cnt_prev:l fingerprint_tslast_sec:l",
       """select event_id, cast(row_number() over w = 1 as int) as is_new_device_for_customer, is_new_device_for_customer as is_new_fingerprint_for_customer, row_number() over w - 1 as fingerprint_cnt_prev,
       coalesce(event_ts - lag(event_ts) over w, -1) as fingerprint_tslast_sec from ev window w as (partition by customer_id, fp order by event_ts, event_id)""")  # fmt: skip
def _(spark, sf):
    return prefix.fingerprints(ready(spark, sf)).result()


@query("device_tz_lang_drift", "event_id:l device_change_flag:l timezone_change_flag:l lang_change_flag:l device_change_count_7d:l timezone_change_count_7d:l lang_change_count_7d:l",
       f"""select event_id, device_change_flag, timezone_change_flag, lang_change_flag, {_sum("device_change_flag", 604800)} as device_change_count_7d, {_sum("timezone_change_flag", 604800)} as timezone_change_count_7d,
       {_sum("lang_change_flag", 604800)} as lang_change_count_7d from (select *, """ + ", ".join(f"coalesce(cast(lag({x}) over ({K}) <> {x} as int), 0) as {n}_change_flag" for x, n in (("fp", "device"), ("timezone", "timezone"), ("lp", "lang"))) + " from ev)")  # fmt: skip
def _(spark, sf):
    return prefix.drift(ready(spark, sf, {prefix.WEEK: ()})).result()


@query("battery_features", "event_id:l battery_level:f battery_missing_flag:l battery_bucket:l battery_jump_flag:l",
       f"""select event_id, coalesce(x, -1) as battery_level, cast(x is null as int) as battery_missing_flag, case when x is null then -1 when x <= 5 then 0 when x <= 20 then 1 when x <= 80 then 2 when x <= 100 then 3 else 4 end as battery_bucket,
       coalesce(cast(x is not null and lag(x) over ({K}) is not null and abs(x - lag(x) over ({K})) >= 40 as int), 0) as battery_jump_flag from (select *, try_cast(battery as double) as x from ev)""")  # fmt: skip
def _(spark, sf):
    return prefix.battery(ready(spark, sf)).result()


@query("session_prefix", "event_id:l session_key:s session_event_index:l session_cnt_so_far:l session_duration_so_far:l session_amt_sum_so_far:f session_has_device_risk_flag:l session_fallback_30m_used:l",
       f"""select event_id, session_key, row_number() over w as session_event_index, row_number() over w as session_cnt_so_far, event_ts - first(event_ts) over w as session_duration_so_far,
       (sum(cents) over w)::bigint / 100::double as session_amt_sum_so_far, max(greatest({_RISK}, {_LM})) over w as session_has_device_risk_flag, cast({_WEAK} as int) as session_fallback_30m_used
       from ev window w as (partition by customer_id, session_key order by event_ts, event_id rows unbounded preceding)""")  # fmt: skip
def _(spark, sf):
    return prefix.sessions(ready(spark, sf)).result()


@query("amount_over_prev_mean", "event_id:l prev_mean_amt:r amt_over_prev_mean:r",
       f"""select event_id, m as prev_mean_amt, operaton_amt / (m + 1) as amt_over_prev_mean from (select *,
       coalesce(sum(cents) over ({K} rows between unbounded preceding and 1 preceding)::double / count(*) over ({K} rows between unbounded preceding and 1 preceding) / 100, 0) as m from ev)""")  # fmt: skip
def _(spark, sf):
    return prefix.amount_over_mean(ready(spark, sf)).result()


_SUMMED = _sum("device_change_flag", 604800)


@query("lookback_week", "event_id:l seq_customer_idx:l rolling_count_7d:l sum_amt_7d:f max_amt_7d:f dt_since_prev_sec:l dt_since_prev_same_mcc_sec:l is_new_mcc:l fingerprint_cnt_prev:l fingerprint_tslast_sec:l device_change_count_7d:l battery_level:f session_event_index:l session_amt_sum_so_far:f",
       f"""select * from (select event_id, week_start, row_number() over ({K}) - 1 as seq_customer_idx, {_cnt(604800)} as rolling_count_7d, {_sum("cents", 604800)}::bigint / 100::double as sum_amt_7d, {_max("cents", 604800)} / 100::double as max_amt_7d,
       coalesce(event_ts - lag(event_ts) over ({K}), 0) as dt_since_prev_sec, coalesce(event_ts - lag(event_ts) over (partition by customer_id, mcc_code order by event_ts, event_id), -1) as dt_since_prev_same_mcc_sec,
       cast(row_number() over (partition by customer_id, mcc_code order by event_ts, event_id) = 1 as int) as is_new_mcc, row_number() over (partition by customer_id, fp order by event_ts, event_id) - 1 as fingerprint_cnt_prev,
       coalesce(event_ts - lag(event_ts) over (partition by customer_id, fp order by event_ts, event_id), -1) as fingerprint_tslast_sec, {_SUMMED} as device_change_count_7d, coalesce(try_cast(battery as double), -1) as battery_level,
       row_number() over (partition by customer_id, session_key order by event_ts, event_id) as session_event_index, (sum(cents) over (partition by customer_id, session_key order by event_ts, event_id rows unbounded preceding))::bigint / 100::double as session_amt_sum_so_far
       from (select *, coalesce(cast(lag(fp) over ({K}) <> fp as int), 0) as device_change_flag from ev)) where week_start = date '{WEEK4}'""")  # fmt: skip
def _(spark, sf):
    from causeway.plans import lookback
    from causeway.sources.sinks import workspace

    t, began = timed(spark, sf), int(dt.datetime.combine(WEEK4, dt.time(), dt.UTC).timestamp())
    state = lookback.look_back(t.filter(F.col("event_ts") < began), began, prefix.sequence_first, f"{workspace(spark)}/look-back-{uuid.uuid4().hex}")
    return lookback.week_features(state, t.filter(F.col("week_start") == F.lit(WEEK4)), prefix.sequence_first)


@query("sequence_first_pack", "event_id:l rolling_count_7d:l dt_since_prev_sec:l is_new_mcc:l device_change_count_7d:l battery_bucket:l session_event_index:l amount_bucket:l is_night:l",
       f"""select event_id, least({_cnt(604800)}, 20) as rolling_count_7d, coalesce(event_ts - lag(event_ts) over ({K}), 0) as dt_since_prev_sec, cast(row_number() over (partition by customer_id, mcc_code order by event_ts, event_id) = 1 as int) as is_new_mcc,
       {_SUMMED} as device_change_count_7d, case when x is null then -1 when x <= 5 then 0 when x <= 20 then 1 when x <= 80 then 2 when x <= 100 then 3 else 4 end as battery_bucket,
       row_number() over (partition by customer_id, session_key order by event_ts, event_id) as session_event_index, cast(event_hour <= 5 or event_hour >= 23 as int) as is_night,
       case when ln(1 + operaton_amt) <= 2 then 0 when ln(1 + operaton_amt) <= 6 then 1 when ln(1 + operaton_amt) <= 10 then 2 when ln(1 + operaton_amt) <= 14 then 3 else 4 end as amount_bucket
       from (select *, try_cast(battery as double) as x, coalesce(cast(lag(fp) over ({K}) <> fp as int), 0) as device_change_flag from ev)""")  # fmt: skip
def _(spark, sf):
    return prefix.sequence_first(timed(spark, sf), cap=20, ultra_burst=True)


# Profiles

_DIST = lambda c: f"count(distinct {c}) + max(cast({c} is null as int)) as pre_n_{c}"
_PROFILE = f"""select customer_id, count(*) as pre_n_events, {_DIST("event_date")}, sum(cents)::bigint / count(*)::double / 100 as pre_mean_amt, coalesce(stddev_samp(operaton_amt), 0) as pre_std_amt,
 {", ".join(_DIST(c) for c in profile.COUNTED)}, max(event_ts) as pre_last_ts from ev where week_start = date '2024-01-01' group by customer_id"""
_PRE = "pre_n_events:l pre_n_event_date:l pre_mean_amt:f pre_std_amt:r pre_n_event_type_nm:l pre_n_event_desc:l pre_n_channel_indicator_type:l pre_n_channel_indicator_sub_type:l pre_n_mcc_code:l pre_last_ts:l"


def pretrain_profile(spark, sf):
    t = timed(spark, sf)
    return profile.customer_profile(t.filter("event_dttm >= '2024-01-01 00:00:00' and event_dttm < '2024-01-08 00:00:00'"))


@query("customer_profile", "customer_id:l " + _PRE, _PROFILE)
def _(spark, sf):
    return pretrain_profile(spark, sf)


@query("profile_join", "event_id:l customer_id:l pre_n_events:l pre_mean_amt:f pre_n_mcc_code:l gap_from_pretrain_last_sec:l",
       f"select event_id, customer_id, coalesce(pre_n_events, 0) as pre_n_events, coalesce(pre_mean_amt, 0) as pre_mean_amt, coalesce(pre_n_mcc_code, 0) as pre_n_mcc_code, event_ts - coalesce(pre_last_ts, 0) as gap_from_pretrain_last_sec from ev left join ({_PROFILE}) using (customer_id)")
def _(spark, sf):
    return profile.join_profile(timed(spark, sf), pretrain_profile(spark, sf))


# Risk

_G = "order by event_ts, event_id rows between unbounded preceding and 1 preceding"


def _risk(name: str) -> None:
    keys = risk.KEYS[name]
    n, part = risk.prefix_name(keys), f"partition by {', '.join(keys)} {_G}"
    lab, pos = "cast(target >= 0 as int)", "cast(target = 1 as int)"
    sql = f"""select event_id, c as {n}_cnt_prev, cast(c = 0 as int) as {n}_is_new, coalesce(event_ts - t, -1) as {n}_tslast_sec, q as {n}_pos_prev, (q + 20.0 * case when gc > 0 then gp::double / gc else 0.5 end) / (c + 20.0) as {n}_risk_smooth
    from (select *, coalesce(sum({lab}) over ({part}), 0)::bigint as c, coalesce(sum({pos}) over ({part}), 0)::bigint as q, max(case when target >= 0 then event_ts end) over ({part}) as t,
    coalesce(sum({lab}) over ({_G}), 0)::bigint as gc, coalesce(sum({pos}) over ({_G}), 0)::bigint as gp from ev)"""

    @query(f"risk_train_{name}", f"event_id:l {n}_cnt_prev:l {n}_is_new:l {n}_tslast_sec:l {n}_pos_prev:l {n}_risk_smooth:r", sql)
    def _(spark, sf):
        return risk.online_risk(timed(spark, sf), [keys])


for _n in risk.KEYS:
    _risk(_n)

_M = risk.prefix_name(risk.KEYS["mcc"])


@query("risk_frozen_valid", f"event_id:l {_M}_cnt_prev:l {_M}_is_new:l {_M}_tslast_sec:l {_M}_pos_prev:l {_M}_risk_smooth:r",
       f"""select event_id, coalesce(c, 0) as {_M}_cnt_prev, cast(coalesce(c, 0) = 0 as int) as {_M}_is_new, coalesce(event_ts - t, -1) as {_M}_tslast_sec, coalesce(q, 0) as {_M}_pos_prev,
       (coalesce(q, 0) + 20.0 * (select sum(cast(target = 1 as int))::double / count(*) from ev where target >= 0 and week_start < date '{WEEK4}')) / (coalesce(c, 0) + 20.0) as {_M}_risk_smooth
       from ev left join (select customer_id, mcc_code, count(*) as c, sum(cast(target = 1 as int))::bigint as q, max(event_ts) as t from ev where target >= 0 and week_start < date '{WEEK4}' group by all) s
       on ev.customer_id = s.customer_id and ev.mcc_code is not distinct from s.mcc_code where week_start = date '{WEEK4}'""")  # fmt: skip
def _(spark, sf):
    t = timed(spark, sf)
    keys = risk.KEYS["mcc"]
    own = risk.fit_state(t.filter(F.col("week_start") < F.lit(WEEK4)), keys)
    return risk.online_risk(t.filter(F.col("week_start") == F.lit(WEEK4)), [keys], mode="valid", state={_M: own})


@query("risk_prior_weighted", "prior:r", "select sum(case when target = 1 then 1.0 else 0 end) / sum(case when target = 1 then 1.0 else 0.5 end) as prior from ev where target >= 0")
def _(spark, sf):
    return risk.weighted_prior(encode.with_weights(timed(spark, sf), reviewed_negative=0.5), "weight")


# Encoding


@query("category_codes", "col:s value:s code:l", " union all ".join(
       f"select '{c}' as col, v as value, row_number() over (order by f, v) - 1 as code from (select {_T(c)} as v, min(event_id) as f from canon group by 1)" for c in encode.CATEGORICAL))
def _(spark, sf):
    return encode.fit_categories(canon(spark, sf), encode.CATEGORICAL)


@query("encode_apply", "event_id:l mcc_code_code:l event_desc_code:l",
       f"""select event_id, coalesce(m.code, -1) as mcc_code_code, coalesce(d.code, -1) as event_desc_code from (select *, {_T("mcc_code")} as mv, {_T("event_desc")} as dv from ev)
       left join (select v, row_number() over (order by f) - 1 as code from (select {_T("mcc_code")} as v, min(event_id) as f from ev where week_start < date '{WEEK4}' group by 1)) m on m.v = mv
       left join (select v, row_number() over (order by f) - 1 as code from (select {_T("event_desc")} as v, min(event_id) as f from ev where week_start < date '{WEEK4}' group by 1)) d on d.v = dv""")  # fmt: skip
def _(spark, sf):
    t = timed(spark, sf)
    return encode.encode_categories(t, encode.fit_categories(t.filter(F.col("week_start") < F.lit(WEEK4)), ["mcc_code", "event_desc"]), ["mcc_code", "event_desc"])


@query("target_rates", "event_id:l mcc_code_target:r event_desc_target:r",
       "select event_id, " + ", ".join(f"(coalesce(p{c}, 0) + 0.5) / (coalesce(n{c}, 0) + 1.0) as {c}_target" for c in ("mcc_code", "event_desc")) + " from ev " +
       " ".join(f"left join (select {_T(c)} as v{c}, count(*) as n{c}, sum(cast(target = 1 as int)) as p{c} from ev where target >= 0 and week_start < date '{WEEK4}' group by 1) on v{c} = {_T(c)}" for c in ("mcc_code", "event_desc")) + f" where week_start = date '{WEEK4}'")
def _(spark, sf):
    t, columns = timed(spark, sf), ["mcc_code", "event_desc"]
    return encode.apply_targets(t.filter(F.col("week_start") == F.lit(WEEK4)), encode.fit_targets(t.filter(F.col("week_start") < F.lit(WEEK4)), columns), columns)


@query("target_rates_ordered", "event_id:l target:l mcc_code_target:r event_type_nm_target:r", None)
def _(spark, sf):
    return encode.ordered_targets(timed(spark, sf), ["mcc_code", "event_type_nm"])


@query("sample_weights", "target:l rows:l y_sum:l weight_sum:r unlabeled_ratio:r",
       "select target, count(*) as rows, sum(cast(target = 1 as int)) as y_sum, sum(case target when 1 then 1.0 when 0 then 0.7 else 0.01 end) as weight_sum, count(*) / greatest((select count(*) from ev where target >= 0), 1e-9) as unlabeled_ratio from ev group by target")
def _(spark, sf):
    w = encode.with_weights(timed(spark, sf), 0.7, 0.01)
    total = w.agg(F.count_if(F.col("target") >= 0).alias("labeled"))  # one row
    out = w.groupBy("target").agg(F.count(F.lit(1)).alias("rows"), F.sum("y").alias("y_sum"), F.sum("weight").alias("weight_sum"))
    return out.crossJoin(total).withColumn("unlabeled_ratio", F.col("rows") / F.greatest(F.col("labeled").cast("double"), F.lit(1e-9)))


# Folds and metrics

_FOLDS = f"(select row_number() over (order by week_start) - 1 as fold, week_start as v from (select distinct week_start from ev order by week_start desc limit {FOLDS}))"
_EXP = f"(select ev.*, fold, case when week_start < v then 'train' else 'valid' end as role from ev join {_FOLDS} on week_start <= v)"
_SEEN = f"exists (select 1 from {_EXP} h where h.role = 'train' and h.fold = x.fold and h.customer_id = x.customer_id)"
_SLICED = f"""(select *, unnest(list_filter(['all', case when target >= 0 then 'labeled' end, case when event_date = d then 'last_day' end, case when seen then 'seen' else 'cold' end], lambda i: i is not null)) as slice
 from (select x.*, max(event_date) over (partition by fold, customer_id) as d, {_SEEN} as seen from {_EXP} x where role = 'valid'))"""
_STEPS = f"(select fold, slice, score, count(*) as n, sum(cast(target = 1 as int)) as tp from {_SLICED} group by all)"
_AP = f"""(select fold, slice, sum(n) as rows, sum(tp) as positives, case when sum(tp) > 0 then sum(tp * p) / sum(tp) else 0 end as average_precision
 from (select *, sum(tp) over w / (sum(n) over w)::double as p from {_STEPS} window w as (partition by fold, slice order by score desc rows unbounded preceding)) group by fold, slice)"""


def expanded(spark, sf):
    t = scored(timed(spark, sf))
    return E.expand_folds(t, E.rolling_week_folds(t, FOLDS, TRAIN_WEEKS))


def sliced(spark, sf):
    x = expanded(spark, sf)
    return E.with_slices(x.filter("role = 'valid'"), x.filter("role = 'train'"))


@query("week_folds", "fold:l week_start:d", f"select fold, v as week_start from {_FOLDS}")
def _(spark, sf):
    return expanded(spark, sf).filter("role = 'valid'").select("fold", "week_start").distinct()


@query("fold_counts", "fold:l role:s rows:l labeled:l red:l positive_rate:r",
       f"select fold, role, count(*) as rows, sum(cast(target >= 0 as int)) as labeled, sum(cast(target = 1 as int)) as red, sum(cast(target = 1 as int)) / count(*)::double as positive_rate from {_EXP} group by all")
def _(spark, sf):
    return E.fold_counts(expanded(spark, sf))


@query("average_precision_by_fold_slice", "fold:l slice:s rows:l positives:l average_precision:r", f"select * from {_AP}")
def _(spark, sf):
    return E.average_precision(sliced(spark, sf), ["fold", "slice"])


@query("recall_at_k", "fold:l slice:s k:l hits:l recall:r",
       f"""select fold, slice, k, sum(case when r <= k then y else 0 end) as hits, case when sum(y) > 0 then sum(case when r <= k then y else 0 end) / sum(y)::double else 0 end as recall
       from (select fold, slice, cast(target = 1 as int) as y, row_number() over (partition by fold, slice order by score desc, event_id) as r from {_SLICED}), (select unnest([100, 500, 1000]) as k) group by all""")  # fmt: skip
def _(spark, sf):
    return E.recall_at(sliced(spark, sf), ["fold", "slice"], [100, 500, 1000])


@query("cv_summary", "slice:s mean:r std:r folds:l", f"select slice, avg(average_precision) as mean, stddev_pop(average_precision) as std, count(*) as folds from {_AP} group by slice")
def _(spark, sf):
    return E.cv_summary(E.average_precision(sliced(spark, sf), ["fold", "slice"]), ["slice"])


@query("score_quantiles", "mean:r std:r q50:r q90:r q99:r q999:r",
       "select avg(score) as mean, stddev_samp(score) as std, quantile_cont(score, 0.5) as q50, quantile_cont(score, 0.9) as q90, quantile_cont(score, 0.99) as q99, quantile_cont(score, 0.999) as q999 from ev")
def _(spark, sf):
    return E.score_stats(scored(timed(spark, sf)))


@query("sigmoid_scores", "event_id:l sigmoid:r finite:l", "select event_id, 1 / (1 + exp(-greatest(least((score - 0.5) * 200, 40), -40))) as sigmoid, 1 as finite from ev")
def _(spark, sf):
    x = S.sigmoid((F.col("score") - 0.5) * 200)
    return scored(timed(spark, sf)).withColumns({"sigmoid": x, "finite": S.finite(x).cast("int")})


@query("seen_cold_customers", "event_id:l customer_id:l seen:l",
       f"select event_id, customer_id, cast(customer_id in (select customer_id from ev where week_start < date '{WEEK4}') as int) as seen from ev where week_start = date '{WEEK4}'")
def _(spark, sf):
    t = timed(spark, sf)
    return E.seen_cold(t.filter(F.col("week_start") == F.lit(WEEK4)), t.filter(F.col("week_start") < F.lit(WEEK4)))


@query("last_day_events", "event_id:l customer_id:l event_date:d", "select * from ev qualify event_date = max(event_date) over (partition by customer_id)")
def _(spark, sf):
    return E.last_day(timed(spark, sf))


@query("id_set_difference", "event_id:l side:s",
       f"select event_id, case when target >= 0 then 'missing' else 'extra' end as side from ev where (target >= 0) <> (week_start = date '{WEEK4}')")
def _(spark, sf):
    c = timed(spark, sf)
    a, b = c.filter("target >= 0").select("event_id"), c.filter(F.col("week_start") == F.lit(WEEK4)).select("event_id")
    return a.join(b, "event_id", "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, "event_id", "left_anti").withColumn("side", F.lit("extra")))


@query("submission_checks", "check_name:s status:s detail:l value:r",
       f"""select unnest(['row_count', 'duplicates', 'missing_ids', 'extra_ids', 'finite', 'not_constant', 'spread', 'same_order', 'score_mean', 'score_q50', 'score_q90', 'score_q99', 'score_q999']) as check_name,
       unnest([case when n = want then 'ok' else 'fail' end, 'ok', case when miss = 0 then 'ok' else 'fail' end, case when extra = 0 then 'ok' else 'fail' end, 'ok', 'ok', 'ok', 'info', 'info', 'info', 'info', 'info', 'info']) as status,
       unnest([n, 0, miss, extra, 0, vals, vals, null, null, null, null, null, null]) as detail, unnest([null, null, null, null, null, null, sd, null, m, q50, q90, q99, q999]) as value
       from (select count(*) filter (w) as n, count(*) filter (l) as want, count(*) filter (l and not w) as miss, count(*) filter (w and not l) as extra, count(distinct score) filter (w) as vals,
       stddev_samp(score) filter (w) as sd, avg(score) filter (w) as m, quantile_cont(score, 0.5) filter (w) as q50, quantile_cont(score, 0.9) filter (w) as q90, quantile_cont(score, 0.99) filter (w) as q99, quantile_cont(score, 0.999) filter (w) as q999
       from (select *, week_start = date '{WEEK4}' as w, target >= 0 as l from ev))""")  # fmt: skip
def _(spark, sf):
    t = scored(timed(spark, sf))
    return E.submission_checks(t.filter(F.col("week_start") == F.lit(WEEK4)).select("event_id", F.col("score").alias("predict")), t.filter("target >= 0"))


@query("run_leaderboard", "run:s average_precision:r positives:l",
       """select run, sum(tp * p) / sum(tp) as average_precision, sum(tp) as positives from (select *, sum(tp) over w / (sum(n) over w)::double as p from
       (select 'c' || channel_indicator_sub_type || 'p' || pos_cd || 't' || channel_indicator_type as run, score, count(*) as n, sum(cast(target = 1 as int)) as tp from ev group by all) window w as (partition by run order by score desc rows unbounded preceding))
       group by run order by round(average_precision, 10) desc, run limit 20""")  # fmt: skip
def _(spark, sf):
    t = scored(timed(spark, sf)).withColumn("run", F.expr("concat('c', channel_indicator_sub_type, 'p', pos_cd, 't', channel_indicator_type)"))
    return E.leaderboard(E.average_precision(t, ["run"]).withColumn("m", F.round("average_precision", 10)), "m")


@query("ablation_slices", "config:s rows:l positives:l average_precision:r",
       " union all ".join(f"""select '{n}' as config, sum(n) as rows, sum(tp) as positives, sum(tp * p) / sum(tp) as average_precision from (select *, sum(tp) over w / (sum(n) over w)::double as p from
       (select {s} as s, count(*) as n, sum(cast(target = 1 as int)) as tp from ev group by all) window w as (order by s desc rows unbounded preceding))""" for n, s in (("base", "score"), ("by_type", "event_type_nm"), ("by_channel", "channel_indicator_sub_type"), ("by_hour", "event_hour"))))  # fmt: skip
def _(spark, sf):
    t = scored(timed(spark, sf))
    variants = {"base": "score", "by_type": "event_type_nm", "by_channel": "channel_indicator_sub_type", "by_hour": "event_hour"}
    long = t.select("target", F.explode(F.array(*[F.struct(F.lit(n).alias("config"), F.col(c).cast("double").alias("score")) for n, c in variants.items()])).alias("x")).select("target", "x.*")
    return E.average_precision(long, ["config"])


# Sequences

_L, _S_, _MIN = 16, 4, 8
_TOK = lambda c: f"case when {c} >= 0 then {c} + 3 else 1 end"
def _windows(length: int, stride: int, least: int) -> str:
    return f"""(select customer_id, w, count(*) as size, list(event_id order by i) as ids, list({_TOK("event_type_nm")} order by i) as ets, list({_TOK("channel_indicator_sub_type")} order by i) as cts, list(event_ts // 3600 % 24 + 1 order by i) as hts
 from (select *, row_number() over ({K}) - 1 as i, count(*) over (partition by customer_id) as n from ev), range(0, 10000) r(w)
 where n >= {least} and w * {stride} <= i and i < w * {stride} + {length} and w <= (case when n <= {length} then 0 else ceil((n - {length}) / {stride}::double) end) group by customer_id, w having count(*) >= {least})"""


_WINDOWS = _windows(_L, _S_, _MIN)


def windows(spark, sf):
    return sequences.count_windows(timed(spark, sf), _L, _S_, _MIN)


def joined(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query("sequence_windows", "customer_id:l w:l size:l event_ids:s event_tokens:s channel_tokens:s hour_tokens:s",
       f"select customer_id, w, size, array_to_string(ids, ',') as event_ids, array_to_string(ets, ',') as event_tokens, array_to_string(cts, ',') as channel_tokens, array_to_string(hts, ',') as hour_tokens from {_WINDOWS}")
def _(spark, sf):
    return windows(spark, sf).withColumns({"event_ids": joined("event_id"), "event_tokens": joined("event_token"), "channel_tokens": joined("channel_token"), "hour_tokens": joined("hour_token")})


@query("sequence_targets", "customer_id:l w:l next_events:s next_channels:s",
       f"select customer_id, w, array_to_string(list_append(ets[2:], -100), ',') as next_events, array_to_string(list_append(cts[2:], -100), ',') as next_channels from {_WINDOWS}")
def _(spark, sf):
    return sequences.next_targets(windows(spark, sf)).withColumns({"next_events": joined("next_event"), "next_channels": joined("next_channel")})


@query("sequence_padded", "customer_id:l w:l event_ids:s event_tokens:s mask:s",
       f"""select customer_id, w, array_to_string(list_resize(ids, {_L}, -1), ',') as event_ids, array_to_string(list_resize(ets, {_L}, 0), ',') as event_tokens,
       array_to_string(list_resize(list_transform(ets, lambda x: 1), {_L}, 0), ',') as mask from {_WINDOWS}""")  # fmt: skip
def _(spark, sf):
    return sequences.pad_windows(windows(spark, sf), _L).withColumns({"event_ids": joined("event_id"), "event_tokens": joined("event_token"), "mask": joined("attention_mask")})


@query("vocab_sizes", "event_vocab_size:l channel_vocab_size:l", "select greatest(4, max(event_type_nm) + 4) as event_vocab_size, greatest(4, max(channel_indicator_sub_type) + 4) as channel_vocab_size from ev")
def _(spark, sf):
    return sequences.vocabulary_sizes(timed(spark, sf))


@query("delta_log", "event_id:l delta_log:r", f"select event_id, ln(1 + least(greatest(coalesce(event_ts - lag(event_ts) over ({K}), 0), 0), 2592000)::double) as delta_log from ev")
def _(spark, sf):
    return prefix.gaps(ready(spark, sf)).result().withColumn("delta_log", S.delta_log(F.col("dt_since_prev_sec")))


@query("mlm_masking", "customer_id:l w:l masked:s labels:s", None)
def _(spark, sf):
    return sequences.mask_tokens(windows(spark, sf), 9).withColumns({"masked": joined("masked_event"), "labels": joined("mlm_label")})


@query("embedding_mean_pool", "label:l pos:l mean:r n:l",
       "select label, pos, avg(x::double) as mean, count(*) as n from (select label, unnest(embedding) as x, unnest(range(0, len(embedding))) as pos from embeddings) group by all")
def _(spark, sf):
    return sequences.mean_pool(spark.read.parquet(f"{sf}/embeddings.parquet"), "label", "embedding")


# Model, streaming

FEATURES = ["event_type_nm", "channel_indicator_sub_type", "event_hour", "log_amt", "rolling_count_1d", "rolling_count_7d", "dt_since_prev_sec", "is_new_mcc"]


@query("gbt_scores", "event_id:l target:l margin:f probability_red:f sigmoid:f", None)
def _(spark, sf):
    from causeway.plans import model

    t = prefix.rolling(prefix.first_seen(prefix.gaps(ready(spark, sf, prefix.ROLLING)))).result()
    train = encode.with_weights(t.filter((F.col("week_start") < F.lit(WEEK4)) & (F.col("target") >= 0)))
    return model.score(model.fit(train, FEATURES, trees=5, depth=4), t.filter(F.col("week_start") == F.lit(WEEK4)), FEATURES)


@query("second_order_scores", "event_id:l target:l margin:f probability_red:f sigmoid:f", None)
def _(spark, sf):
    from causeway.plans import model

    t = prefix.rolling(prefix.first_seen(prefix.gaps(ready(spark, sf, prefix.ROLLING)))).result()
    train = encode.with_weights(t.filter((F.col("week_start") < F.lit(WEEK4)) & (F.col("target") >= 0)))
    return model.score(model.fit(train, FEATURES, trees=5, depth=4, rate=0.3, kind="second_order"), t.filter(F.col("week_start") == F.lit(WEEK4)), FEATURES)


@query("stream_bucket_counts", "bucket_ts:l event_type:s n:l cents:l",
       "select cast(epoch(ts) as bigint) // 1800 * 1800 as bucket_ts, event_type, count(*) as n, sum(cast(round(value * 100) as bigint))::bigint as cents from (select date_trunc('second', ts) as ts, event_type, value from events) group by 1, 2")
def _(spark, sf):
    return stream.drained(stream.bucket_counts(stream.stream(spark, f"{sf}/events.parquet")), "buckets", ["bucket_ts", "event_type"])


@query("stream_last_seen", "customer_id:l last_ts:l event_id:l event_type:s n:l",
       "select user_id as customer_id, cast(epoch(date_trunc('second', ts)) as bigint) as last_ts, event_id, event_type, n from (select *, count(*) over (partition by user_id) as n, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1")
def _(spark, sf):
    return stream.drained(stream.last_seen(stream.stream(spark, f"{sf}/events.parquet")), "last_seen", ["customer_id"])


@query("stream_online_risk", "event_id:l cnt_prev:l is_new:l tslast_sec:l pos_prev:l risk_smooth:r",
       f"""select event_id, c as cnt_prev, cast(c = 0 as int) as is_new, coalesce(event_ts - t, -1) as tslast_sec, q as pos_prev, (q + 20.0 * 0.5) / (c + 20.0) as risk_smooth
       from (select *, coalesce(sum(cast(target >= 0 as int)) over (partition by customer_id, mcc_code {_G}), 0)::bigint as c, coalesce(sum(cast(target = 1 as int)) over (partition by customer_id, mcc_code {_G}), 0)::bigint as q,
       max(case when target >= 0 then event_ts end) over (partition by customer_id, mcc_code {_G}) as t from ev) where event_ts < (select max(event_ts) - 3600 from ev)""")  # fmt: skip
def _(spark, sf):
    from causeway.sources.sinks import workspace
    from causeway.streaming import risk as online

    raw = stream.stream(spark, f"{sf}/events.parquet")
    return online.run_online_risk(S.with_time(C.derived(raw)), risk.KEYS["mcc"], f"{workspace(spark)}/stream-risk-{uuid.uuid4().hex}")


def _cfg():
    from causeway.plans.config import Config

    return Config(unlabeled_modulo=MODULO, n_folds=FOLDS, min_train_weeks=TRAIN_WEEKS, pretrain_profile=False)


@query("sequence_first_run", "fold:l slice:s rows:l positives:l average_precision:f", None)
def _(spark, sf):
    from causeway.plans import pipelines

    return pipelines.run(spark, canon(spark, sf), _cfg(), trees=3, depth=3).by_fold


@query("baseline_run", "fold:l slice:s rows:l positives:l average_precision:f", None)
def _(spark, sf):
    from causeway.plans import pipelines

    return pipelines.run(spark, canon(spark, sf), _cfg(), track="baseline", trees=3, depth=3).by_fold


_EXPORTED = 32, 16, 8


@query("sequence_export_targets", "customer_id:l w:l size:l event_ids:s event_tokens:s channel_tokens:s hour_tokens:s attention:s next_events:s next_channels:s",
       f"""select customer_id, w, size, array_to_string(list_resize(ids, {_EXPORTED[0]}, -1), ',') as event_ids, array_to_string(list_resize(ets, {_EXPORTED[0]}, 0), ',') as event_tokens, array_to_string(list_resize(cts, {_EXPORTED[0]}, 0), ',') as channel_tokens,
       array_to_string(list_resize(hts, {_EXPORTED[0]}, 0), ',') as hour_tokens, array_to_string(list_resize(list_transform(ets, lambda x: 1), {_EXPORTED[0]}, 0), ',') as attention,
       array_to_string(list_append(ets[2:], -100), ',') as next_events, array_to_string(list_append(cts[2:], -100), ',') as next_channels from {_windows(*_EXPORTED)}""")  # fmt: skip
def _(spark, sf):
    from causeway.plans import pipelines

    out = pipelines.export_sequences(canon(spark, sf), _cfg().override(sequence_length=_EXPORTED[0], sequence_stride=_EXPORTED[1], sequence_least=_EXPORTED[2]))
    names = {"event_ids": "event_id", "event_tokens": "event_token", "channel_tokens": "channel_token", "hour_tokens": "hour_token", "attention": "attention_mask", "next_events": "next_event", "next_channels": "next_channel"}
    return out.withColumns({n: joined(c) for n, c in names.items()})


@query("sequence_export", "customer_id:l w:l size:l masked:s labels:s next_events:s", None)
def _(spark, sf):
    from causeway.plans import pipelines

    out = pipelines.export_sequences(canon(spark, sf), _cfg().override(sequence_length=32, sequence_stride=16))
    return out.withColumns({"masked": joined("masked_event"), "labels": joined("mlm_label"), "next_events": joined("next_event")})


@query("ablation_run", "config:s use_sequence:l graph_mode:s use_unlabeled:l slice:s mean:f std:f folds:l", None)
def _(spark, sf):
    from causeway.plans import pipelines

    return pipelines.ablation(spark, canon(spark, sf), _cfg().override(n_folds=1), trees=2, depth=3)
