"""Customer profiles from an unlabeled period, and their join to events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions import scalars as S

# Fixed names: the columns whose distinct values a profile counts.
COUNTED = ["event_type_nm", "event_desc", "channel_indicator_type", "channel_indicator_sub_type", "mcc_code"]


def customer_profile(events: DataFrame) -> DataFrame:
    """Ten measures for each customer; distinct counts take null as a value.

    Each task gathers the values of a customer as sets, whose size is that of a column's vocabulary, so rows are neither
    copied for each column nor shuffled.
    """
    distinct = lambda c: (F.size(F.collect_set(c)) + F.max(F.col(c).isNull().cast("int"))).alias(f"pre_n_{c}")
    return events.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("pre_n_events"), distinct("event_date"), (F.sum(S.cents()) / F.count(F.lit(1)) / 100).alias("pre_mean_amt"),
        F.coalesce(F.stddev_samp("operaton_amt"), F.lit(0.0)).alias("pre_std_amt"), *[distinct(c) for c in COUNTED], F.max("event_ts").alias("pre_last_ts"),
    )


def join_profile(events: DataFrame, profile: DataFrame) -> DataFrame:
    """Events with their customer's profile; 0 where there is none, and then the gap is the whole event time."""
    out = events.join(profile, "customer_id", "left").fillna(0, [c for c in profile.columns if c != "customer_id"])
    return out.withColumn("gap_from_pretrain_last_sec", F.col("event_ts") - F.col("pre_last_ts"))
