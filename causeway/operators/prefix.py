"""Causal features of one customer's ordered events: windows, gaps, novelty, drift, sessions.

Every function takes a ``Timeline`` of canonical events with ``with_time`` columns and adds columns; none looks ahead.
``timeline`` deals events by ranges of customer, time and id, so that no task needs all events of a customer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions import scalars as S
from causeway.operators import frames
from causeway.operators.frames import Timeline
from causeway.operators.ordered import first, most, previous, total

MINUTE, HOUR, DAY, WEEK = 60, 3600, 86_400, 604_800
#: Windows of the packs, and whether amounts are summed up in them.
ROLLING = {10 * MINUTE: (), HOUR: (), DAY: ("_cents",), WEEK: ("_cents",)}
ULTRA_BURST = {MINUTE: (), 5 * MINUTE: ("_cents",), 30 * MINUTE: ()}
BASELINE = {HOUR: (), DAY: (), WEEK: ()}


def timeline(df: DataFrame, windows: dict[int, tuple[str, ...]] | None = None, parts: int | None = None, past: dict | None = None, log: list | None = None) -> Timeline:
    """Events with a time, dealt for frames of the given seconds; ``parts``: so many ranges, else as the amount of data says;
    ``past``, ``log``: what earlier events left, and where these events' scans are noted."""
    return frames.timeline(df, windows or {}, {"_cents": S.cents()}, parts=parts, past=past, log=log)


def rolling(t: Timeline, cap: int | None = None, ultra_burst: bool = False) -> Timeline:
    """Counts, amounts and burst ratios of the last 10 minutes to 7 days; ``cap``: at most so many last events."""
    out = t.over(DAY, {"_sum_1d": "_cents"}, cap=cap).over(WEEK, {"_sum_7d": "_cents"}, {"_max_7d": "_cents"}, cap)
    counts = (("10m", 10 * MINUTE), ("1h", HOUR), ("1d", DAY), ("7d", WEEK))
    made = {f"rolling_count_{n}": t.count(w, cap) for n, w in counts} | {"sum_amt_1d": F.col("_sum_1d") / 100, "sum_amt_7d": F.col("_sum_7d") / 100, "max_amt_7d": F.col("_max_7d") / 100}
    out = out.with_columns_of(made).with_columns_of({
        "mean_amt_7d": S.ratio(F.col("sum_amt_7d"), F.col("rolling_count_7d")),
        "burst_10m_over_1h": S.ratio(F.col("rolling_count_10m"), F.col("rolling_count_1h")),
        "burst_1h_over_1d": S.ratio(F.col("rolling_count_1h"), F.col("rolling_count_1d")),
    })
    if ultra_burst:
        out = out.over(5 * MINUTE, {"_sum_5m": "_cents"}, cap=cap)
        made = {f"rolling_count_{n}": t.count(w, cap) for n, w in (("1m", MINUTE), ("5m", 5 * MINUTE), ("30m", 30 * MINUTE))} | {"sum_amt_5m": F.col("_sum_5m") / 100}
        out = out.with_columns_of(made).with_columns_of({"burst_5m_over_1d": S.ratio(F.col("rolling_count_5m"), F.col("rolling_count_1d"))})
    return out


def since(c: str, none: int) -> Column:
    """Seconds since the time in a column."""
    return F.coalesce(F.col("event_ts") - F.col(c), F.lit(none))


def gaps(t: Timeline) -> Timeline:
    """Place in the sequence and seconds since the previous event, of any kind, of the same channel, of the same mcc."""
    ts = F.col("event_ts")
    out = t.scan({"_prev": previous(ts)}).scan({"_prev_channel": previous(ts)}, ("channel_indicator_sub_type",)).scan({"_prev_mcc": previous(ts)}, ("mcc_code",))
    out = out.with_columns_of({
        "seq_customer_idx": F.col("_rn") - 1, "dt_since_prev_sec": since("_prev", 0), "dt_since_prev_same_channel_sec": since("_prev_channel", -1), "dt_since_prev_same_mcc_sec": since("_prev_mcc", -1),
    })
    return out.with_columns_of({"time_since_last_seen_mcc_sec": F.col("dt_since_prev_same_mcc_sec")})


def first_seen(t: Timeline) -> Timeline:
    """Whether the customer has the event type, mcc or sub-channel for the first time; null is a value."""
    out = t
    for c, n in (("event_type_nm", "event_type"), ("mcc_code", "mcc"), ("channel_indicator_sub_type", "channel")):
        out = out.scan({f"_nth_{n}": total(F.lit(1))}, (c,))
        out = out.with_columns_of({f"is_new_{n}": (F.col(f"_nth_{n}") == 1).cast("int")})
    return out


def fingerprints(t: Timeline, history: bool = True) -> Timeline:
    """Device fingerprint, its novelty, and (unless off: 0 and -1) how often and when it was seen before."""
    out = t.with_columns({"device_fingerprint": S.fingerprint()})
    out = out.scan({"_nth_device": total(F.lit(1)), "_prev_device": previous(F.col("event_ts"))}, ("device_fingerprint",))
    new = (F.col("_nth_device") == 1).cast("int")
    seen, last = (F.col("_nth_device") - 1, since("_prev_device", -1)) if history else (F.lit(0), F.lit(-1).cast("long"))
    return out.with_columns_of({"is_new_device_for_customer": new, "is_new_fingerprint_for_customer": new, "fingerprint_cnt_prev": seen, "fingerprint_tslast_sec": last})


def drift(t: Timeline, geo_lang: bool = True) -> Timeline:
    """Changes of device, time zone and languages, now and in the last 7 days."""
    watched = {"device": S.fingerprint(), "timezone": S.token("timezone")} | ({"lang": S.language_pair()} if geo_lang else {})
    out = t.scan({f"_prev_{n}": previous(x) for n, x in watched.items()}, deep=True)
    out = out.with_columns({f"{n}_change_flag": F.coalesce((F.col(f"_prev_{n}") != x).cast("int"), F.lit(0)) for n, x in watched.items()})
    counted = list(watched) if geo_lang else ["device"]
    return out.over(WEEK, {f"{n}_change_count_7d": f"{n}_change_flag" for n in counted})


def battery(t: Timeline) -> Timeline:
    """Battery level and bucket (-1 if missing), and whether it jumped by 40 or more."""
    out = t.with_columns({"battery_level": F.coalesce(S.battery_level(), F.lit(-1.0))}).scan({"_prev_battery": previous(F.col("battery_level"))})
    now, before = F.col("battery_level"), F.col("_prev_battery")
    jump = (now >= 0) & (before >= 0) & (F.abs(now - before) >= 40)
    return out.with_columns_of({
        "battery_missing_flag": S.battery_level().isNull().cast("int"), "battery_bucket": S.battery_bucket(S.battery_level()), "battery_jump_flag": F.coalesce(jump.cast("int"), F.lit(0)),
    })


def sessions(t: Timeline, fallback: bool = True) -> Timeline:
    """The session so far: events, seconds, amount, and whether a device risk has shown."""
    out = t.with_columns({"session_key": S.session_key(fallback)})
    risk = F.greatest(S.device_risk(), S.language_mismatch())
    out = out.scan({"session_event_index": total(F.lit(1)), "_session_began": first(F.col("event_ts")), "_session_cents": total(F.col("_cents")), "session_has_device_risk_flag": most(risk)}, ("session_key",))
    return out.with_columns_of({
        "session_duration_so_far": F.col("event_ts") - F.col("_session_began"), "session_amt_sum_so_far": F.col("_session_cents") / 100,
        "session_fallback_30m_used": (S.weak_session() if fallback else F.lit(False)).cast("int"), "session_cnt_so_far": F.col("session_event_index"),
    })


def amount_over_mean(t: Timeline) -> Timeline:
    """The amount over one more than the mean of all earlier amounts (0 if none)."""
    out = t.scan({"_earlier_cents": total(F.col("_cents"), before=True)})
    mean = F.when(F.col("_rn") > 1, F.col("_earlier_cents") / (F.col("_rn") - 1) / 100).otherwise(F.lit(0.0))
    return out.with_columns_of({"prev_mean_amt": mean}).with_columns_of({"amt_over_prev_mean": F.col("operaton_amt") / (F.col("prev_mean_amt") + 1)})


def baseline_pack(df: DataFrame, parts: int | None = None, past: dict | None = None, log: list | None = None) -> DataFrame:
    """The smaller pack: counts of the last hour, day and week, burst with an epsilon, gaps, novelty and amount over mean."""
    t = timeline(df, BASELINE, parts, past, log)
    out = t.with_columns_of({f"rolling_count_{n}": t.count(w) for n, w in (("1h", HOUR), ("1d", DAY), ("7d", WEEK))})
    out = out.with_columns_of({"burst_1h_over_1d": F.col("rolling_count_1h") / (F.col("rolling_count_1d") + 1e-6)})
    return amount_over_mean(first_seen(gaps(out))).result()


def sequence_first(df: DataFrame, cap: int | None = None, ultra_burst: bool = False, fingerprint_novelty: bool = True, geo_lang_drift: bool = True, session_fallback: bool = True, parts: int | None = None, past: dict | None = None, log: list | None = None) -> DataFrame:
    """The full pack over events that have ``with_time`` columns; rows without time are left out."""
    out = first_seen(gaps(timeline(df, ROLLING | (ULTRA_BURST if ultra_burst else {}), parts, past, log)))
    out = sessions(battery(fingerprints(out, fingerprint_novelty)), session_fallback)
    # Frames that look up rows by number deal the rows anew, so they come last.
    out = rolling(drift(out, geo_lang_drift), cap, ultra_burst)
    return out.with_columns_of({"rdp_or_root_flag": S.device_risk(), "lang_mismatch_flag": S.language_mismatch(), "amount_bucket": S.amount_bucket(), "is_night": S.is_night()}).result()
