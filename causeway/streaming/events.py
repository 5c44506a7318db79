"""Structured Streaming twins: 30-minute buckets with a watermark, and the last event of each customer."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.sources.sinks import workspace


def stream(spark: SparkSession, path: str) -> DataFrame:
    """The event files at a path or glob as a stream, with ``ts`` as a timestamp."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    # A file source reads folders: the folder is given, and the file's name as a filter.
    out = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return out.withColumn("ts", F.col("ts").cast("timestamp"))


def bucket_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events and amounts in cents of each 30 minutes and event type."""
    w = F.window("ts", "30 minutes")
    out = events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return out.select(F.unix_timestamp(F.col("window.start")).alias("bucket_ts"), "event_type", "n", "cents")


def last_seen(events: DataFrame) -> DataFrame:
    """The last event of each customer (by time, then id) and how many there were; the state is one row for each customer."""
    last = F.max(F.struct("ts", "event_id", "event_type"))
    out = events.groupBy(F.col("user_id").alias("customer_id")).agg(last.alias("last"), F.count(F.lit(1)).alias("n"))
    return out.select("customer_id", F.unix_timestamp("last.ts").alias("last_ts"), F.col("last.event_id").alias("event_id"), F.col("last.event_type").alias("event_type"), "n")


def drained(query: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Runs a streaming query over all there is, into a table in the shared folder; a row for each of ``keys``, its last.

    Update mode: state behind the watermark is dropped. A micro-batch that runs again overwrites its own folder.
    """
    spark = query.sparkSession
    base = f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/table/epoch={epoch}")

    q = query.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows, rest = spark.read.parquet(f"{base}/table"), [c for c in query.columns if c not in keys]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "epoch").alias(c) for c in rest]).select(*query.columns)
