import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from causeway.functions import scalars as S
from causeway.operators import encode, prefix, risk
from causeway.plans import evaluation as E
from causeway.plans import lookback, model, pipelines, states
from causeway.plans.config import Config
from causeway.sources import canonical as C
from causeway.sources import sinks
from causeway.sources.sinks import store

CFG = Config(unlabeled_modulo=10, n_folds=1, min_train_weeks=3, ultra_burst=False)


def test_run_scores_a_test_week(spark, sf, tmp_path):
    all_ = C.events(spark, sf).filter("customer_id < 40").cache()
    test = all_.filter("event_dttm >= '2024-01-29 00:00:00'").drop("target")
    train = all_.filter("event_dttm < '2024-01-29 00:00:00'")
    pretrain = train.filter("event_dttm < '2024-01-08 00:00:00'").drop("target")
    out = pipelines.run(spark, train, CFG, track="baseline", pretrain=pretrain, test=test, trees=3, depth=3, live=str(tmp_path / "live"), model_path=str(tmp_path / "model"))
    by = {r.slice: r for r in out.by_fold.collect()}
    assert {"all", "labeled", "seen", "last_day"} <= set(by)
    assert by["all"].rows == train.filter("event_dttm >= '2024-01-22 00:00:00'").count()
    assert by["labeled"].average_precision > by["labeled"].positives / by["labeled"].rows
    status = {r.check_name: r.status for r in E.submission_checks(out.submission.select("event_id", "predict"), test).collect()}
    assert set(status.values()) == {"ok", "info"}
    live = spark.read.csv(str(tmp_path / "live"), header=True, inferSchema=True)
    assert {r.slice: r.rows for r in live.collect()} == {s: r.rows for s, r in by.items()}
    fitted, names = model.load(str(tmp_path / "model"))
    rows = spark.createDataFrame([tuple(float(i * j % 7) for j in range(len(names))) for i in range(20)], names)
    assert model.importance(fitted, names) == out.importance and model.score(fitted, rows, names).filter("margin is not null").count() == 20
    for name in ("a", "b"):
        pipelines.write_outputs(spark, out, CFG, str(tmp_path / "out"), name)
    assert {r.run for r in sinks.read_runs(spark, str(tmp_path / "out" / "runs")).filter("all_mean is not null").collect()} == {"a", "b"}
    assert spark.read.parquet(str(tmp_path / "out" / "b" / "out_of_fold_last_day")).count() == by["last_day"].rows
    log = [json.loads(x) for x in (tmp_path / "out" / "tracking" / "b" / "log.jsonl").read_text().splitlines()]
    assert [x["kind"] for x in log][:2] == ["params", "metrics"] and log[-1]["status"] == "FINISHED" and (tmp_path / "out" / "tracking" / "b" / "summary.json").exists()
    assert json.loads((tmp_path / "out" / "latest.json").read_text())["run"] == "b"
    assert spark.read.csv(str(tmp_path / "out" / "b" / "submission"), header=True).count() == test.count()
    assert out.importance[0][1] >= out.importance[-1][1] and any("ogr_" in n for n, _ in out.importance)


def test_sequence_export(spark, sf):
    out = pipelines.export_sequences(C.events(spark, sf).filter("customer_id < 5"), CFG.override(sequence_length=32, sequence_stride=16))
    assert out.count() > 5
    assert out.filter((F.size("event_token") != 32) | (F.size("masked_event") != F.col("size"))).count() == 0


    capped = pipelines.export_sequences(C.events(spark, sf), CFG.override(max_event_rows=5000))
    first = pipelines.export_sequences(C.events(spark, sf).filter("event_id < 5000"), CFG)
    assert capped.count() == first.count() > 0


def test_ablation_compares_settings(spark, sf):
    canon = C.events(spark, sf).filter("customer_id < 20")
    out = pipelines.ablation(spark, canon, CFG, trees=2, depth=2).collect()
    assert {r.config for r in out} == set(pipelines.ABLATIONS) and len(out) == 6 * len({r.slice for r in out})
    assert len({(r.use_sequence, r.graph_mode, r.use_unlabeled) for r in out}) == 6


@pytest.mark.parametrize("names, values", [(("base", "labeled_only_counts"), {}), (("base_graph", "labeled_only"), {"full_week_eval": False, "max_eval_week_rows": 150, "graph_prior": "train_rate"})])
def test_ablation_makes_features_once_and_equals_single_runs(spark, sf, monkeypatch, names, values):
    """Second-order trees do not depend on how rows are dealt, so the summaries are those of a run for each setting."""
    canon, cfg, built = C.events(spark, sf).filter("customer_id < 20"), CFG.override(booster="second_order", **values), []
    build = pipelines.baseline_features
    monkeypatch.setattr(pipelines, "baseline_features", lambda *a: built.append(a) or build(*a))
    got = {(r.config, r.slice): r for r in pipelines.ablation(spark, canon, cfg, trees=2, depth=2, names=names).collect()}
    assert len(built) == 1
    want = {}
    for n in names:
        own = cfg.override(pretrain_profile=False).override(**pipelines.ABLATIONS[n])
        want |= {(n, r.slice): (own, r) for r in pipelines.run(spark, canon, own, "baseline", trees=2, depth=2).summary.collect()}
    assert got.keys() == want.keys() and len({r["mean"] for r in got.values()}) > 2
    for k, (own, r) in want.items():
        assert abs(got[k]["mean"] - r["mean"]) < 1e-12 and (got[k].std, got[k].folds) == (r.std, r.folds)
        assert (got[k].use_sequence, got[k].graph_mode, got[k].use_unlabeled) == (int(own.use_sequence), own.graph_mode, int(own.use_unlabeled))


def test_settings_of_the_ablation_choose_the_columns_of_their_own_runs(spark, sf):
    canon = C.events(spark, sf).filter("customer_id < 5")
    settings, whole = pipelines.settings_of(CFG, tuple(pipelines.ABLATIONS))
    columns = lambda cfg: pipelines.features_of(made := pipelines.baseline_features(canon, cfg)) + [f"{c}_code" for c in encode.CATEGORICAL if c in made.columns]
    every = columns(whole)
    for own in settings.values():
        assert pipelines.features_under(every, S.with_time(canon).columns, own) == columns(own)


def test_labels_of_the_valid_week_change_no_feature_of_it(spark, sf):
    canon = C.events(spark, sf).filter("customer_id < 40")
    week = "2024-01-22"
    late = F.col("event_dttm") >= f"{week} 00:00:00"
    seen = []
    for flip in (False, True):
        own = canon.withColumn("target", F.when(late & F.lit(flip) & (F.col("target") >= 0), 1 - F.col("target")).otherwise(F.col("target")))
        made = pipelines.baseline_features(own, CFG)
        cfg, day = CFG.override(graph_prior="train_rate"), dt.date.fromisoformat(week)
        fitted = pipelines.fit_states(made, [(0, day)], cfg, "baseline")
        rows = pipelines.frozen_rows(made.filter(F.col("week_start") == F.lit(day)), fitted, 0, cfg, "baseline")
        seen.append(sorted(tuple(r) for r in rows.select("event_id", *pipelines.features_of(rows)).collect()))
    assert len(seen[0]) > 100 and seen[0] == seen[1]


def test_scores_that_are_all_distinct(spark):
    """Average precision and quantiles by ranges, against plain Python; no window takes a whole group."""
    rows = [(i % 2, (i * 7919 % 1009) / 1009 + i * 1e-6, int(i * 31 % 7 == 0)) for i in range(1000)]
    df = spark.createDataFrame(rows, "fold int, score double, target int")
    for r in E.average_precision(df, ["fold"]).collect():
        own = sorted((x for x in rows if x[0] == r.fold), key=lambda x: -x[1])
        hits, total = 0, 0.0
        for n, x in enumerate(own, 1):
            hits += x[2]
            total += x[2] * hits / n
        assert abs(r.average_precision - total / hits) < 1e-12 and r.rows == len(own)
    s = sorted(x[1] for x in rows)
    got = E.score_stats(df).first()
    for q, v in ((0.5, got.q50), (0.9, got.q90), (0.99, got.q99), (0.999, got.q999)):
        lo = int((len(s) - 1) * q)
        part = (len(s) - 1) * q - lo
        assert abs(v - (s[lo] * (1 - part) + s[min(lo + 1, len(s) - 1)] * part)) < 1e-9
    assert E.score_stats(df.limit(0)).first().q50 is None


def test_folds_read_states_that_one_scan_gathered(spark, sf):
    """The states of four folds equal fits on each fold's own history; the history is scanned once, and no fold reads it again."""
    canon = C.events(spark, sf).filter("customer_id < 25")
    cfg = CFG.override(graph_prior="train_rate")
    made = store(pipelines.baseline_features(canon, cfg), "features")
    path = made.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    sets = list(risk.KEYS.values())
    deltas = states.weekly_deltas(made, encode.CATEGORICAL, sets)
    scans = lambda df: len(re.findall(r"FileScan parquet", df._jdf.queryExecution().executedPlan().toString()))
    assert scans(deltas) == 1
    folds = [(0, dt.date(2024, 1, 8)), (1, dt.date(2024, 1, 15)), (2, dt.date(2024, 1, 22)), (3, None)]
    fitted = states.fold_states(store(deltas, "deltas"), folds, encode.CATEGORICAL, "train_rate")
    for fold, week in folds:
        history = made if week is None else made.filter(F.col("week_start") < F.lit(week))
        prior = risk.weighted_prior(history).first().prior
        for keys in sets:
            name = risk.prefix_name(keys)
            want, got = risk.fit_state(history, keys, prior), fitted.risk(fold, sets)[name]
            assert sorted(map(tuple, got.edges.collect())) == sorted(map(tuple, want.edges.select(got.edges.columns).collect()))
            assert got.total == want.total and abs(got.prior - prior) < 1e-12
            assert path not in got.edges._jdf.queryExecution().toString()
        want = encode.fit_categories(history, encode.CATEGORICAL)
        assert sorted(map(tuple, fitted.categories(fold).collect())) == sorted(map(tuple, want.collect()))
        # The online risk that was made once is that of a run over the fold's training weeks alone.
        old = risk.online_risk(history.drop(*[c for c in history.columns if c.startswith("ogr_")]), sets, prior=prior)
        names = [c for c in made.columns if c.startswith("ogr_")]
        new = pipelines.training_rows(history, fitted, fold, cfg, "baseline").select("event_id", *names)
        a, b = ({r.event_id: r[1:] for r in x.select("event_id", *names).collect()} for x in (old, new))
        assert a.keys() == b.keys() and all(abs(x - y) < 1e-12 for k in a for x, y in zip(a[k], b[k], strict=True))


def test_no_raw_category_beside_its_code(spark, sf):
    canon = C.events(spark, sf).filter("customer_id < 5")
    fitted = pipelines.fit_states(made := pipelines.baseline_features(canon, CFG), [(0, None)], CFG, "baseline")
    names = pipelines.features_of(pipelines.training_rows(made, fitted, 0, CFG, "baseline"))
    assert "event_type_nm_code" in names and not {"event_type_nm", "event_desc", "pos_cd", pipelines.SEEN} & set(names)


def test_a_week_from_what_the_history_left(spark, sf, tmp_path):
    """Two weeks in turn, from state, tail and their own events, equal the features of the whole stream; the history is not scanned."""
    events = S.with_time(C.events(spark, sf)).filter("customer_id < 12").withColumn("customer_id", F.when(F.col("customer_id") > 5, 7).otherwise(F.col("customer_id")))
    path = str(tmp_path / "history")
    events.write.parquet(path)
    events = spark.read.parquet(path)
    first = int(dt.datetime(2024, 1, 15, tzinfo=dt.UTC).timestamp())
    between = lambda lo, hi: events.filter((F.col("event_ts") >= lo) & (F.col("event_ts") < hi))
    for k, pack in enumerate((lambda df, **how: prefix.sequence_first(df, 20, True, parts=3, **how), lambda df, **how: prefix.baseline_pack(df, **how))):
        state = lookback.look_back(events.filter(F.col("event_ts") < first), first, pack, str(tmp_path / f"s{k}"))
        whole = {r.event_id: r for r in pack(events).collect()}
        for n in range(2):
            lo, hi = first + n * lookback.REACH, first + (n + 1) * lookback.REACH
            own = str(tmp_path / f"w{k}{n}")
            between(lo, hi).write.parquet(own)
            week = spark.read.parquet(own)
            got = lookback.week_features(state, week, pack)
            assert path not in got._jdf.queryExecution().toString()
            rows = {r.event_id: r for r in got.collect()}
            assert len(rows) == week.count() > 50
            for e, r in rows.items():
                assert r.asDict() == whole[e].asDict()
            state = lookback.advanced(state, week, pack, str(tmp_path / f"s{k}{n}"))
            assert path not in str([t._jdf.queryExecution().toString() for t in state.tables.values()])
