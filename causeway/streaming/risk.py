"""The online risk of edges as a stream: rows wait in Spark's keyed state until the watermark has passed their second.

Rows may come out of order by less than the watermark's delay. The rows of an edge and second are one group of an append
aggregation, which gives them once the watermark has passed the second; rows that come later than the delay are dropped.
So what a micro-batch gives is later than all that earlier ones gave, and its rows are read before they write in (time, id)
order, as the batch operator does it: by a scan over range pieces, on top of what earlier micro-batches left. Edges do not
see one another, so the prior is frozen for each micro-batch: the rate of the labeled rows that earlier micro-batches put
out. Each micro-batch writes rows, totals and edges into folders of its own, which it replaces if it runs again, so a restart
from the checkpoint gives no row twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.scalars import smoothed
from causeway.operators.ordered import Scan, deal, most, total
from causeway.operators.risk import key_text
from causeway.sources.sinks import exists

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows that share time and id follow in the order of their labels.
ORDER = ["event_ts", "event_id", "target"]


def scans() -> dict[str, Scan]:
    """Labeled rows, positives and last time of what came before."""
    labeled = F.col("target") >= 0
    return {"cnt_prev": total(labeled.cast("long"), before=True), "pos_prev": total((F.col("target") == 1).cast("long"), before=True), "_last": most(F.when(labeled, F.col("event_ts")), before=True)}


def passed_rows(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """A stream of canonical events with times (event_dt, event_ts) and targets as (``_<key>``, event_id, event_ts, target) of
    the rows whose second the watermark has passed."""
    own, edge = events.filter("event_ts is not null").withWatermark("event_dt", late), [f"_{k}" for k in keys]
    row = F.struct("event_id", F.col("target").cast("int").alias("target"))
    held = own.groupBy(*[key_text(k).alias(f"_{k}") for k in keys], "event_ts", F.window("event_dt", "1 second")).agg(F.collect_list(row).alias("held"))
    return held.select(*edge, "event_ts", F.inline("held")).select(*edge, "event_id", "event_ts", "target")


def tables(n: int) -> Iterator[int]:
    """The tables that hold together what the first ``n`` micro-batches left, as many as ``n`` has binary ones: table k is of the
    last micro-batches up to the k-th, as many as the lowest binary one of k says."""
    while n:
        yield n
        n &= n - 1


def run_online_risk(events: DataFrame, keys: list[str], folder: str, late: str = "1 hour", prior: float = 0.5, alpha: float = 20.0) -> DataFrame:
    """Runs the stream over all there is, from the checkpoint in ``folder`` where there is one, and gives all rows so far:
    those of ``passed_rows`` with cnt_prev, pos_prev, tslast_sec, is_new, ``prior``, ``risk_smooth`` and ``epoch``."""
    spark, edge, made = events.sparkSession, [f"_{k}" for k in keys], scans()
    schema = ", ".join([*[f"{k} string" for k in edge], *[f"{n} long" for n in made]])

    def left(some: list[int], more: DataFrame | None = None) -> DataFrame:
        """Edges in some of the tables, and in ``more``; each once."""
        out = spark.read.schema(schema).parquet(*[f"{folder}/edges/upto={k}" for k in some]) if some else spark.createDataFrame([], schema)
        return (out if more is None else out.unionByName(more)).groupBy(*edge).agg(*[s.merged(n).alias(n) for n, s in made.items()])

    def write(batch: DataFrame, epoch: int) -> None:
        n = p = 0
        if exists(spark, f"{folder}/totals"):
            earlier = spark.read.parquet(f"{folder}/totals").filter(F.col("epoch") < epoch).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("p"), F.lit(0)))
            n, p = earlier.first()  # a row for each micro-batch
        now = F.lit(float(p / n if n else prior))
        batch.write.mode("overwrite").parquet(f"{folder}/passed/epoch={epoch}")
        own = deal(spark.read.schema(batch.schema).parquet(f"{folder}/passed/epoch={epoch}"), edge, ORDER)
        past = {"-".join(["all", *made]): left([*tables(epoch)])} if epoch else None
        tslast = F.coalesce(F.col("event_ts") - F.col("_last"), F.lit(-1))
        out = replace(own, past=past).scan(made).rows.withColumns({"tslast_sec": tslast, "is_new": (F.col("cnt_prev") == 0).cast("int"), "prior": now, "risk_smooth": smoothed(F.col("pos_prev"), F.col("cnt_prev"), now, alpha)})
        out.drop("_part", "_last").write.mode("overwrite").parquet(f"{folder}/rows/epoch={epoch}")
        labeled = own.rows.filter("target >= 0")
        lasting = labeled.groupBy(*edge).agg(F.count(F.lit(1)).alias("cnt_prev"), F.count_if(F.col("target") == 1).alias("pos_prev"), F.max("event_ts").alias("_last"))
        # Table epoch + 1 takes in those that end before it and begin after the last one that it leaves.
        within = [k for k in tables(epoch) if k > (epoch + 1) & epoch]
        left(within, lasting).write.mode("overwrite").parquet(f"{folder}/edges/upto={epoch + 1}")
        labeled.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("target") == 1).alias("p")).write.mode("overwrite").parquet(f"{folder}/totals/epoch={epoch}")

    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        q = passed_rows(events, keys, late).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    return spark.read.parquet(f"{folder}/rows")
