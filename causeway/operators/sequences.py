"""Event sequences for representation learning: count windows, tokens, padding, targets, masking, pooling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions import scalars as S
from causeway.operators.frames import timeline
from causeway.operators.ordered import previous, total

PAD, UNKNOWN, MASK, IGNORE = 0, 1, 2, -100


def count_windows(df: DataFrame, length: int = 128, stride: int = 32, least: int = 8, parts: int | None = None) -> DataFrame:
    """(customer_id, w, size, tokens...): windows of ``length`` events that begin every ``stride``, the last one reaching the end.

    Shorter windows and customers than ``least`` are left out. Tokens are arrays in event order.
    """
    named = df.filter("customer_id is not null and event_id is not null")
    t = timeline(named, {}, parts=parts).scan({"_prev": previous(F.col("event_ts"))}).scan({"_left": total(F.lit(1))}, reverse=True)
    rows = t.rows.select(
        "customer_id", "event_id", (F.col("_rn") - 1).alias("i"), (F.col("_rn") + F.col("_left") - 1).alias("n"),
        S.tokenize(F.coalesce("event_type_nm", F.lit(-1))).alias("event_token"), S.tokenize(F.coalesce("channel_indicator_sub_type", F.lit(-1))).alias("channel_token"),
        S.hour_token(F.col("event_ts")).alias("hour_token"), S.delta_log(F.coalesce(F.col("event_ts") - F.col("_prev"), F.lit(0))).alias("delta_log"),
    )
    last = F.when(F.col("n") <= length, 0).otherwise(F.ceil((F.col("n") - length) / stride)).cast("int")
    lo = F.greatest(F.lit(0), F.ceil((F.col("i") - length + 1) / stride)).cast("int")
    hi = F.least(F.floor(F.col("i") / stride).cast("int"), last)
    spread = rows.filter(F.col("n") >= least).withColumns({"lo": lo, "hi": hi}).filter("lo <= hi").withColumn("w", F.explode(F.sequence("lo", "hi")))
    parts = F.array_sort(F.collect_list(F.struct("i", "event_id", "event_token", "channel_token", "hour_token", "delta_log")))  # at most ``length``
    grouped = spread.groupBy("customer_id", "w").agg(parts.alias("p")).filter(F.size("p") >= least)
    return grouped.select("customer_id", "w", F.size("p").alias("size"), *[F.col(f"p.{c}").alias(c) for c in ("event_id", "event_token", "channel_token", "hour_token", "delta_log")])


def padded(c: Column, length: int, fill) -> Column:
    return F.concat(c, F.array_repeat(F.lit(fill), F.greatest(F.lit(0), F.lit(length) - F.size(c))))


def pad_windows(windows: DataFrame, length: int = 128) -> DataFrame:
    """Token arrays of exactly ``length``, and the mask of their real places."""
    out = windows.withColumn("attention_mask", padded(F.transform("event_token", lambda _: F.lit(1)), length, 0))
    fills = {"event_id": -1, "event_token": PAD, "channel_token": PAD, "hour_token": PAD, "delta_log": 0.0}
    return out.withColumns({c: padded(F.col(c), length, F.lit(x).cast(windows.schema[c].dataType.elementType)) for c, x in fills.items()})


def next_targets(windows: DataFrame) -> DataFrame:
    """For each place the next token; none (``IGNORE``, or -1 for the delta) at the last."""
    shift = lambda c, none: F.concat(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), F.array(F.lit(none)))
    return windows.withColumns({"next_event": shift("event_token", IGNORE), "next_channel": shift("channel_token", IGNORE), "next_delta": shift("delta_log", -1.0)})


def mask_tokens(windows: DataFrame, vocabulary: int, share: float = 0.15, seed: int = 1) -> DataFrame:
    """Masked tokens and their labels, by a seeded hash of event and window: 80 % mask, 10 % random, 10 % kept.

    One place at least is masked, unless ``share`` is 0.
    """
    if share <= 0:
        return windows.withColumns({"masked_event": F.col("event_token"), "mlm_label": F.transform("event_token", lambda _: F.lit(IGNORE))})
    unit = lambda e, salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), e, F.col("w")), F.lit(1_000_000)) / 1_000_000
    out = windows.withColumn("_u", F.transform("event_id", lambda e: unit(e, 1)))
    out = out.withColumn("_hit", F.transform("_u", lambda u: (u < share) | (u == F.array_min("_u"))))
    zipped = F.arrays_zip("event_id", "event_token", "_hit")

    def put(x: Column) -> Column:
        how = unit(x["event_id"], 2)
        other = (F.pmod(F.xxhash64(F.lit(seed), F.lit(3), x["event_id"], F.col("w")), F.lit(vocabulary - 3)) + 3).cast("int")
        return F.when(~x["_hit"], x["event_token"]).when(how < 0.8, MASK).when(how < 0.9, other).otherwise(x["event_token"])

    out = out.withColumns({"masked_event": F.transform(zipped, put), "mlm_label": F.transform(zipped, lambda x: F.when(x["_hit"], x["event_token"]).otherwise(IGNORE))})
    return out.drop("_u", "_hit")


def vocabulary_sizes(df: DataFrame) -> DataFrame:
    size = lambda c: F.greatest(F.lit(4), F.max(F.coalesce(c, F.lit(-1))) + 4)
    return df.agg(size("event_type_nm").alias("event_vocab_size"), size("channel_indicator_sub_type").alias("channel_vocab_size"))


def shuffled_files(df: DataFrame, seed: int) -> DataFrame:
    """The input files of ``df`` in a seeded order."""
    return df.select(F.input_file_name().alias("file")).distinct().orderBy(F.xxhash64(F.lit(seed), "file"))


def flatten_hidden(windows: DataFrame, hidden: str = "hidden") -> DataFrame:
    """(customer_id, event_id, vector) of the real places of padded windows whose ``hidden`` is an array of vectors."""
    zipped = F.explode(F.arrays_zip(F.slice("event_id", 1, F.col("size")), F.slice(hidden, 1, F.col("size"))))
    return windows.select("customer_id", zipped.alias("x")).select("customer_id", F.col("x.0").alias("event_id"), F.col("x.1").alias("vector"))


def mean_pool(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, pos, mean, n): the mean vector of each key by component, in double precision."""
    long = df.select(key, F.posexplode(vector).alias("pos", "x"))
    return long.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.count(F.lit(1)).alias("n"))


def pooled_vectors(means: DataFrame, key: str) -> DataFrame:
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda x: x["mean"]).alias("vector"))
