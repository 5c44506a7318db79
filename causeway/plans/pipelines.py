"""The end-to-end runs: sequence-first, baseline with online risk, and sequence export.

Features of events are causal, so they are computed once over the whole stream and every fold is a filter on them; what
happens after an event never changes its features. That holds for the online risk of training rows too. What is fitted
(category codes, and in the baseline the frozen edges and the prior) is fitted for each fold on its training weeks, from
weekly deltas that one scan gathers (``states``); the valid week reads it and changes nothing. The driver only loops over
folds and fits models.
"""

from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions.scalars import with_time
from causeway.operators import encode, prefix, profile, risk, sequences
from causeway.plans import evaluation as E
from causeway.plans import model, states
from causeway.plans.config import Config, switch
from causeway.sources import canonical as C
from causeway.sources import sinks
from causeway.sources.sinks import store

#: How many labeled rows came before a row.
SEEN = "labeled_before"
NOT_FEATURES = {"target", "event_dttm", "event_dt", "event_date", "week_start", "event_id", "y", "weight", "fold", "role", "session_key", "device_fingerprint", SEEN}


@dataclass
class Result:
    """Metrics by fold and slice, their summary, out-of-fold scores, those of each customer's last day in the fold, the submission, and the final model's importances."""

    by_fold: DataFrame
    summary: DataFrame
    recall: DataFrame
    out_of_fold: DataFrame
    last_day: DataFrame
    submission: DataFrame | None = None
    importance: list = field(default_factory=list)


def run_id() -> str:
    return dt.datetime.now(dt.UTC).strftime("%Y%m%d_%H%M%S")


def features_of(df: DataFrame) -> list[str]:
    """Numeric columns that are no labels, times or ids of events, and no raw categories beside their codes."""
    return [c for c, t in df.dtypes if c not in NOT_FEATURES and f"{c}_code" not in df.columns and t in ("int", "bigint", "double", "float", "smallint", "tinyint")]


def columns_like(df: DataFrame, prefix: str = "", suffix: str = "") -> list[str]:
    return [c for c in df.columns if c.startswith(prefix) and c.endswith(suffix)]


def sampled(canon: DataFrame, cfg: Config) -> DataFrame:
    """Training rows: all labels, and of the unlabeled events one in ``unlabeled_modulo`` if the run uses them."""
    label = C.labels(canon)
    if cfg.use_unlabeled:
        return C.train_frame(canon, label, cfg.unlabeled_modulo, cfg.max_labeled_rows, cfg.max_unlabeled_rows)
    return C.labeled_frame(canon, label, cfg.max_labeled_rows)


def sequence_features(canon: DataFrame, cfg: Config, pretrain: DataFrame | None = None) -> DataFrame:
    out = prefix.sequence_first(with_time(canon), cfg.history_window_events, cfg.ultra_burst, cfg.fingerprint_novelty, cfg.geo_lang_drift, cfg.session_fallback)
    if cfg.pretrain_profile and pretrain is not None:
        out = profile.join_profile(out, profile.customer_profile(with_time(pretrain)))
    return out


def baseline_features(canon: DataFrame, cfg: Config, pretrain: DataFrame | None = None) -> DataFrame:
    """The smaller pack, profiles, and each row's online risk as the rows before it left it."""
    out = with_time(canon).filter("event_ts is not null")
    out = prefix.baseline_pack(out) if cfg.use_sequence else out
    if cfg.pretrain_profile and pretrain is not None:
        out = profile.join_profile(out, profile.customer_profile(with_time(pretrain)))
    if cfg.graph_mode != "off":
        prior = 0.5 if cfg.graph_prior == "train_rate" else float(cfg.graph_prior)
        out = risk.online_risk(out, list(risk.KEYS.values()), prior=prior, alpha=cfg.graph_alpha, include_risk=cfg.graph_mode == "full", seen=SEEN)
    return out


def with_risk(track: str, cfg: Config) -> bool:
    return track == "baseline" and cfg.graph_mode != "off"


def fit_states(features: DataFrame, folds: list[tuple], cfg: Config, track: str) -> states.FoldStates:
    """What all ``folds`` fit, from one scan of the features; a fold without a week is fitted on all of them."""
    sets = list(risk.KEYS.values()) if with_risk(track, cfg) else []
    deltas = store(states.weekly_deltas(features, encode.CATEGORICAL, sets), "deltas")
    return states.fold_states(deltas, folds, encode.CATEGORICAL, cfg.graph_prior, cfg.graph_alpha)


def training_rows(rows: DataFrame, own: states.FoldStates, fold: int, cfg: Config, track: str) -> DataFrame:
    """Rows with codes of the fold. Their risk stands already, but for rows before any label, whose risk is the fold's prior."""
    if with_risk(track, cfg) and cfg.graph_mode == "full":
        names = [f"{risk.prefix_name(k)}_risk_smooth" for k in risk.KEYS.values()]
        rows = rows.withColumns({n: F.when(F.col(SEEN) == 0, F.lit(own.prior_of(fold))).otherwise(F.col(n)) for n in names})
    return encode.encode_categories(rows, own.categories(fold), encode.CATEGORICAL)


def frozen_rows(rows: DataFrame, own: states.FoldStates, fold: int, cfg: Config, track: str) -> DataFrame:
    """Rows with codes of the fold and the risk of its frozen edges, whatever their own labels are."""
    if with_risk(track, cfg):
        sets = list(risk.KEYS.values())
        rows = rows.drop(*columns_like(rows, "ogr_"))
        rows = risk.online_risk(rows, sets, "valid", state=own.risk(fold, sets), include_risk=cfg.graph_mode == "full")
    return encode.encode_categories(rows, own.categories(fold), encode.CATEGORICAL)


def by_slice(scores: DataFrame) -> DataFrame:
    """A row for each slice that an event is in: all, labeled, last_day of its customer in the fold, seen or cold."""
    names = F.array_compact(F.array(F.lit("all"), F.when(F.col("target") >= 0, "labeled"), F.when(F.col("_last"), "last_day"), F.when(F.col("seen") == 1, "seen").otherwise("cold")))
    return E.with_last_day(scores, ["fold", "customer_id"]).withColumn("slice", F.explode(names))


def fitted_model(train: DataFrame, names: list[str], cfg: Config, trees: int, depth: int):
    return model.fit(train, names, trees, depth, seed=cfg.seed, kind=cfg.booster, min_child_weight=cfg.min_child_weight, columns_by_tree=cfg.columns_by_tree, reg_lambda=cfg.reg_lambda)


def evaluate(features: DataFrame, train_ids: DataFrame, cfg: Config, trees: int, depth: int, track: str = "sequence", live: str | None = None) -> Result:
    """Rolling weekly folds: fit on the sampled rows of earlier weeks, score the whole valid week, measure by slice.

    ``live``: a CSV folder that is written anew after each fold with the metrics of the folds so far.
    """
    scores = by_fold = None
    folds = E.rolling_week_folds(features, cfg.n_folds, cfg.min_train_weeks)
    fitted = fit_states(features, folds, cfg, track)
    for fold, week in folds:
        history = features.filter(F.col("week_start") < F.lit(week))
        sample = history.join(train_ids.select("event_id"), "event_id", "left_semi")
        train = store(encode.with_weights(training_rows(sample, fitted, fold, cfg, track), cfg.reviewed_negative_weight, cfg.unlabeled_weight), "train")
        names = features_of(train)
        booster = fitted_model(train, names, cfg, trees, depth)
        valid = features.filter(F.col("week_start") == F.lit(week))
        valid = valid if cfg.full_week_eval else valid.join(train_ids.select("event_id"), "event_id", "left_semi")
        own = model.score(booster, C.limited(frozen_rows(valid, fitted, fold, cfg, track), cfg.max_eval_week_rows), names)
        seen = E.seen_cold(own, history)
        own = seen.select(F.lit(fold).alias("fold"), "event_id", "customer_id", "event_date", "target", "seen", F.col("margin").alias("score"), "probability_red")
        own = store(own, "scores")
        measured = store(E.average_precision(by_slice(own), ["fold", "slice"]), "measured")
        scores, by_fold = (own, measured) if scores is None else (scores.unionByName(own), by_fold.unionByName(measured))
        if live:
            sinks.write_csv(by_fold.orderBy("fold", "slice"), live, single=True)
    return Result(by_fold, E.cv_summary(by_fold, ["slice"]), E.recall_at(by_slice(scores), ["fold", "slice"], list(cfg.recall_ks)), scores, E.last_day(scores, ("fold", "customer_id")))


def run(spark: SparkSession, canon: DataFrame, cfg: Config, track: str = "sequence", pretrain: DataFrame | None = None, test: DataFrame | None = None, trees: int = 500, depth: int = 8, live: str | None = None, model_path: str | None = None, use_unlabeled: str = "config") -> Result:
    """Evaluates, and with ``test`` (unlabeled events) fits on all training rows and scores them: (event_id, predict).

    ``track``: sequence or baseline. The test events' features see the training history. ``live``: see ``evaluate``;
    ``model_path``: where the final model is saved; ``use_unlabeled``: config, true or false, over the setting.
    """
    cfg = cfg.override(use_unlabeled=switch(use_unlabeled, cfg.use_unlabeled))
    build = {"sequence": sequence_features, "baseline": baseline_features}[track]
    both = canon if test is None else canon.unionByName(test.withColumn("target", F.lit(-1)).select(canon.columns))
    features = store(build(both, cfg, pretrain), "features")
    train_ids = sampled(canon, cfg).select("event_id")
    own = features if test is None else features.join(test.select("event_id"), "event_id", "left_anti")
    out = evaluate(own, train_ids, cfg, trees, depth, track, live)
    if test is not None:
        states_ = fit_states(own, [(0, None)], cfg, track)
        sample = own.join(train_ids, "event_id", "left_semi")
        train = store(encode.with_weights(training_rows(sample, states_, 0, cfg, track), cfg.reviewed_negative_weight, cfg.unlabeled_weight), "train")
        names = features_of(train)
        rows = frozen_rows(features.join(test.select("event_id"), "event_id", "left_semi"), states_, 0, cfg, track)
        fitted = fitted_model(train, names, cfg, trees, depth)
        if model_path:
            model.save(fitted, model_path)
        rows = C.limited(rows, cfg.max_test_rows)
        out.submission = model.score(fitted, rows, names).select("event_id", F.col("margin").alias("predict"), "sigmoid")
        out.importance = model.importance(fitted, names)
    return out


def write_outputs(spark: SparkSession, out: Result, cfg: Config, folder: str, run: str | None = None) -> str:
    """A run's files under ``folder``/``run`` (its name is a time if none is given), its row in ``folder``/runs, parameters and
    metrics in ``folder``/tracking if the run is tracked, and the latest summary in ``folder``/latest.json. Returns the name.

    Tables go through Spark; the summary and the index, a few values, are written by the driver.
    """
    run = run or run_id()
    place = f"{folder}/{run}"
    small = {"by_fold": out.by_fold.orderBy("fold", "slice"), "summary": out.summary, "recall": out.recall}
    if out.importance:
        small["importance"] = spark.createDataFrame(out.importance, "feature string, importance double")
    for name, df in small.items():
        sinks.write_csv(df, f"{place}/{name}", single=True)
    for name, df in {"out_of_fold": out.out_of_fold, "out_of_fold_last_day": out.last_day}.items():
        df.write.mode("overwrite").parquet(f"{place}/{name}")
    if out.submission is not None:
        sinks.write_csv(out.submission.select("event_id", "predict"), f"{place}/submission")
    mean = {r["slice"]: r.asDict() for r in out.summary.collect()}  # a row for each slice
    sinks.write_summary({"run": run, "config": asdict(cfg), "summary": mean}, f"{place}/summary.json")
    metrics = {f"{s}_{k}": v for s, r in mean.items() for k, v in r.items() if k != "slice"}
    sinks.append_run(spark, f"{folder}/runs", {"run": run, **metrics})
    sinks.point_latest(f"{place}/summary.json", f"{folder}/latest.json")
    tracker = sinks.Tracker(f"{folder}/tracking", run, cfg.tracking)
    tracker.log_params(asdict(cfg))
    tracker.log_metrics(metrics)
    for r in out.by_fold.collect():  # a row for each fold and slice
        tracker.log_metrics({f"{r['slice']}_average_precision": r["average_precision"]}, step=r["fold"])
    tracker.log_artifact(f"{place}/summary.json")
    tracker.end()
    return run


#: Models that the comparison fits at a time.
FITS = 3
# Fixed settings of the comparison.
ABLATIONS = {
    "base": {"use_sequence": False, "graph_mode": "off"}, "base_sequence": {"graph_mode": "off"}, "base_graph": {"use_sequence": False}, "base_sequence_graph": {},
    "labeled_only": {"use_unlabeled": False}, "labeled_only_counts": {"use_unlabeled": False, "graph_mode": "count"},
}


def settings_of(cfg: Config, names: tuple[str, ...]) -> tuple[dict[str, Config], Config]:
    """The named settings, and one that has the features of all of them."""
    own = {n: cfg.override(pretrain_profile=False).override(**ABLATIONS[n]) for n in names}
    modes = [m for m in ("full", "count") if any(s.graph_mode == m for s in own.values())]
    return own, cfg.override(pretrain_profile=False, use_sequence=any(s.use_sequence for s in own.values()), graph_mode=(modes or ["off"])[0])


def features_under(names: list[str], plain: list[str], cfg: Config) -> list[str]:
    """Those of the features ``names`` that the baseline track has under ``cfg``; ``plain``: columns of events with times."""

    def there(c: str) -> bool:
        if c.startswith("ogr_"):
            return cfg.graph_mode == "full" or cfg.graph_mode == "count" and not c.endswith(("_pos_prev", "_risk_smooth"))
        return cfg.use_sequence or c in plain or c.removesuffix("_code") in encode.CATEGORICAL

    return [c for c in names if there(c)]


def ablation(spark: SparkSession, canon: DataFrame, cfg: Config, trees: int = 500, depth: int = 8, names: tuple[str, ...] = tuple(ABLATIONS)) -> DataFrame:
    """Summaries by slice of the baseline track under the named settings of ``ABLATIONS``, with what each setting is.

    A setting only chooses columns and training rows. So features, what folds fit, and the coded rows of a fold are made once
    for all of them; a fold's rows are read once for the models of all settings that score the same rows.
    """
    settings, whole = settings_of(cfg, names)
    plain = with_time(canon).columns
    features = store(baseline_features(canon, whole), "features")
    folds = E.rolling_week_folds(features, cfg.n_folds, cfg.min_train_weeks)
    fitted = fit_states(features, folds, whole, "baseline")
    ids = {u: store(sampled(canon, cfg.override(use_unlabeled=u)).select("event_id"), "train-ids") for u in sorted({s.use_unlabeled for s in settings.values()})}
    scores = None
    for fold, week in folds:
        history = features.filter(F.col("week_start") < F.lit(week))
        every = reduce(DataFrame.unionByName, ids.values())
        coded = store(training_rows(history.join(every, "event_id", "left_semi"), fitted, fold, whole, "baseline"), "coded")
        known = features_of(coded)
        week_rows = features.filter(F.col("week_start") == F.lit(week))
        frozen = frozen_rows(week_rows, fitted, fold, whole, "baseline")
        if cfg.full_week_eval:
            frozen = store(C.limited(frozen, cfg.max_eval_week_rows), "valid")
        train = {u: store(encode.with_weights(coded.join(some, "event_id", "left_semi"), cfg.reviewed_negative_weight, cfg.unlabeled_weight), "train") for u, some in ids.items()}
        chosen = {n: features_under(known, plain, own) for n, own in settings.items()}
        # Fits are many short jobs that leave cores idle, so some run at a time, as in a cross validator.
        fit = inheritable_thread_target(spark)(lambda n: fitted_model(train[settings[n].use_unlabeled], chosen[n], settings[n], trees, depth))
        with ThreadPoolExecutor(FITS) as pool:
            models = dict(zip(settings, pool.map(fit, settings), strict=True))
        for u, some in ids.items():
            rows = frozen if cfg.full_week_eval else C.limited(frozen.join(some, "event_id", "left_semi"), cfg.max_eval_week_rows)
            made = []
            for n in [n for n, own in settings.items() if own.use_unlabeled == u]:
                rows = model.score(models[n], rows, chosen[n]).withColumnRenamed("margin", f"_margin_{n}").drop("probability_red", "sigmoid")
                made.append(F.struct(F.lit(n).alias("config"), F.col(f"_margin_{n}").alias("score")))
            part = E.seen_cold(rows, history).select(F.lit(fold).alias("fold"), "event_id", "customer_id", "event_date", "target", "seen", F.array(*made).alias("_scores"))
            part = store(by_slice(part).select("fold", "slice", "target", F.inline("_scores")), "scores")
            scores = part if scores is None else scores.unionByName(part)
    by_fold = E.average_precision(scores, ["config", "fold", "slice"])
    said = {n: {"use_sequence": int(s.use_sequence), "graph_mode": s.graph_mode, "use_unlabeled": int(s.use_unlabeled)} for n, s in settings.items()}
    of = lambda c: F.coalesce(*[F.when(F.col("config") == n, F.lit(x[c])) for n, x in said.items()])
    return E.cv_summary(by_fold, ["config", "slice"]).withColumns({c: of(c) for c in ("use_sequence", "graph_mode", "use_unlabeled")})


def export_sequences(canon: DataFrame, cfg: Config) -> DataFrame:
    """Padded windows with masked tokens and next-step targets, ready for a trainer; of the first ``max_event_rows`` events if that is set."""
    canon = C.limited(canon, cfg.max_event_rows)
    w = sequences.count_windows(with_time(canon), cfg.sequence_length, cfg.sequence_stride, cfg.sequence_least)
    sizes = sequences.vocabulary_sizes(canon).first()
    return sequences.pad_windows(sequences.next_targets(sequences.mask_tokens(w, sizes.event_vocab_size, seed=cfg.seed)), cfg.sequence_length)
