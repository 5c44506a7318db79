"""Sinks: single CSV and JSON files for small reports, the run registry, and cached tables."""

from __future__ import annotations

import json
import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def workspace(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``); on one machine, where it may be unset, one under /tmp."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = "/tmp/checkpoints/causeway"
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """``single``: one file, for reports that fit in one task."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True)


def jsonable(x):
    """Plain values for JSON: numpy scalars and arrays, times, and NaN as null."""
    if isinstance(x, dict):
        return {str(k): jsonable(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [jsonable(v) for v in x]
    if hasattr(x, "tolist"):
        return jsonable(x.tolist())
    if hasattr(x, "isoformat"):
        return x.isoformat()
    if isinstance(x, float) and (x != x or x in (float("inf"), float("-inf"))):
        return None
    return x


def write_summary(row: dict, path: str) -> None:
    """A run's summary, a few values, from the driver."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(jsonable(row), indent=2, ensure_ascii=False))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever file system it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def build_or_load(spark: SparkSession, path: str, build, refresh: bool = False) -> DataFrame:
    """The Parquet table at ``path``; ``build()`` makes it where it is missing or ``refresh`` is set."""
    if refresh or not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def store(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again, so that later jobs do not compute it anew.

    ``by``: columns of few values, each with a folder of its own, so that a filter on them reads no other.
    """
    path = f"{workspace(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_run(spark: SparkSession, index: str, row: dict) -> DataFrame:
    """Adds a run to the registry, a folder with a file for each run, so runs that end at once do not meet; all runs so far.

    A run that is added again replaces its file. Values are text.
    """
    plain = {k: None if v is None else str(v) for k, v in jsonable(row).items()}
    names = [k for k in plain if k != "run"]
    one = spark.createDataFrame([tuple(plain[k] for k in names)], ", ".join(f"`{k}` string" for k in names))
    one.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(f"{index}/run={plain['run']}")
    return read_runs(spark, index)


def read_runs(spark: SparkSession, index: str) -> DataFrame:
    """All runs, united by name; missing values are null."""
    return spark.read.option("primitivesAsString", True).json(index).withColumn("run", F.col("run").cast("string"))


def point_latest(path: str, latest: str) -> None:
    shutil.copy2(path, latest)


class Tracker:
    """Parameters, metrics and artifacts of a run as JSON lines; does nothing when disabled."""

    def __init__(self, folder: str, run: str, enabled: bool = True):
        self.path = Path(folder) / run if enabled else None
        if self.path:
            self.path.mkdir(parents=True, exist_ok=True)

    def _log(self, kind: str, values: dict) -> None:
        if self.path:
            with (self.path / "log.jsonl").open("a") as f:
                f.write(json.dumps({"kind": kind} | jsonable(values)) + "\n")

    def log_params(self, params: dict) -> None:
        self._log("params", params)

    def log_metrics(self, metrics: dict, step: int | None = None) -> None:
        self._log("metrics", metrics | ({} if step is None else {"step": step}))

    def log_artifact(self, path: str) -> None:
        if self.path:
            shutil.copy2(path, self.path)

    def set_tag(self, key: str, value) -> None:
        self._log("tag", {key: value})

    def end(self, status: str = "FINISHED") -> None:
        self._log("end", {"status": status})
