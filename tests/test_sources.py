import json

import pytest

from causeway.plans import config
from causeway.sources import canonical as C
from causeway.sources import sinks


def test_scan_prunes_and_pushes(spark, sf):
    plan = C.week_frame(spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id", "user_id customer_id", "cast(ts as string) event_dttm", "0 target"), C.labels(C.events(spark, sf)), __import__("datetime").date(2024, 1, 15))
    assert "value" not in plan._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1].split(">")[0]
    assert C.scan(spark, f"{sf}/events.parquet", ["event_id"]).columns == ["event_id"]
    assert C.discover(spark, sf, ["nothing*.parquet", "event*.parquet"]).count() == 10_000
    with pytest.raises(FileNotFoundError):
        C.discover(spark, sf, ["nothing*"])


def test_labels_without_events_stay(spark, sf):
    canon = C.events(spark, sf).filter("event_id < 100")
    label = spark.createDataFrame([(5, 1), (10_000_000, 0)], "event_id long, target int")
    rows = {r.event_id: r for r in C.labeled_frame(canon, label).collect()}
    assert rows[10_000_000].customer_id is None and rows[5].customer_id is not None


def test_tables_and_registry(spark, tmp_path):
    df = spark.range(3)
    path = str(tmp_path / "t")
    assert sinks.build_or_load(spark, path, lambda: df).count() == 3
    assert sinks.build_or_load(spark, path, lambda: spark.range(9)).count() == 3
    assert sinks.build_or_load(spark, path, lambda: spark.range(9), refresh=True).count() == 9
    sinks.write_csv(df, str(tmp_path / "c"), single=True)
    assert sinks.read_csv(spark, str(tmp_path / "c"), "id long").count() == 3
    index = str(tmp_path / "runs")
    sinks.append_run(spark, index, {"run": "a", "ap": 0.5})
    out = sinks.append_run(spark, index, {"run": "b", "recall": float("nan")})
    assert out.count() == 2 and set(out.columns) == {"run", "ap", "recall"}
    sinks.write_summary({"x": float("nan"), "y": [1, 2]}, str(tmp_path / "s.json"))
    assert json.loads((tmp_path / "s.json").read_text()) == {"x": None, "y": [1, 2]}
    t = sinks.Tracker(str(tmp_path), "r")
    t.log_params({"a": 1})
    t.log_metrics({"m": 2.0}, step=1)
    t.end()
    assert len((tmp_path / "r" / "log.jsonl").read_text().splitlines()) == 3
    sinks.Tracker(str(tmp_path), "off", enabled=False).log_params({"a": 1})
    assert not (tmp_path / "off").exists()


def test_config(tmp_path):
    p = tmp_path / "c.json"
    p.write_text('{"seed": 7}')
    assert config.load(str(p)).seed == 7
    with pytest.raises(ValueError):
        config.Config().override(nothing=1)
    assert config.switch("config", True) and not config.switch("false", True)
