"""Micro-frames for the edges that the tables lack, sequential oracles, and metamorphic checks."""

import math
import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from causeway.functions import scalars as S
from causeway.operators import encode, ordered, prefix, profile, risk, sequences
from causeway.operators.frames import timeline
from causeway.plans import evaluation as E
from causeway.sources import canonical as C


def small(spark, rows, schema="customer_id long, event_id long, event_ts long, amt long"):
    return spark.createDataFrame(rows, schema)


def by_id(df, *columns):
    return {r.event_id: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def naive(rows, seconds, cap=None):
    out = {}
    rows = sorted(rows, key=lambda r: (r[0], r[2], r[1]))
    for i, (c, e, t, _) in enumerate(rows):
        own = [x for x in rows[: i + 1] if x[0] == c and x[2] >= t - seconds]
        own = own[-cap:] if cap else own
        out[e] = (len(own), sum(x[3] for x in own), max(x[3] for x in own))
    return out


@pytest.mark.parametrize("parts", [None, 11])
@pytest.mark.parametrize("cap", [None, 3, 5, 20])
def test_frames_with_ties(spark, cap, parts):
    """One range or many, frames in time and frames that a cap cuts, against a plain loop."""
    rng = random.Random(4)
    rows = [(rng.choice([0, 1, 2, None]), i, rng.randrange(40), rng.randrange(100)) for i in range(150)] + [(9, 500 + i, 7, i) for i in range(5)] + [(8, 600 + i, i * 60, i) for i in range(30)]
    rng.shuffle(rows)
    t = timeline(small(spark, rows), {10: ("x",), 3: ()}, {"x": F.col("amt")}, parts=parts)
    assert (t.edge is not None) == (parts is not None)
    for w in (10, 3):
        out = t.over(w, {"s": "x"}, {"m": "x"}, cap).with_columns_of({"n": t.count(w, cap)}).result()
        want = naive([(-1 if r[0] is None else r[0], *r[1:]) for r in rows], w, cap)
        assert by_id(out, "n", "s", "m") == want
    if cap and cap <= 5:
        assert any(v[0] > cap for v in naive([(r[0] or 0, *r[1:]) for r in rows], 10).values())


def test_rows_without_time_and_no_rows(spark):
    t = timeline(small(spark, [(1, 1, None, 5), (1, 2, 4, 5)]), {10: ("x",)}, {"x": F.col("amt")})
    assert by_id(t.with_columns_of({"n": t.count(10)}).result(), "n") == {2: 1}
    assert timeline(small(spark, []), {10: ()}).result().count() == 0


@pytest.mark.parametrize("reverse", [False, True])
def test_scans(spark, reverse):
    """Every kind of scan over pieces of one key, of values inside it, and of values made by an earlier scan."""
    rng = random.Random(8)
    rows = [(rng.choice([1, 1, 1, 2, None]), i, rng.randrange(50), rng.choice([None, 1, 2, 3])) for i in range(300)]
    dealt = ordered.deal(small(spark, rows), ["customer_id"], ["event_ts", "event_id"], 13)
    amt, by = F.col("amt"), ("amt",)
    scans = {"s": ordered.total(amt), "sb": ordered.total(amt, before=True), "m": ordered.most(amt), "mb": ordered.most(amt, before=True), "p": ordered.previous(amt), "f": ordered.first(amt)}
    if reverse:
        scans = {k: scans[k] for k in ("s", "m", "sb", "mb")}
    out = dealt.scan(scans, reverse=reverse, deep=True).scan({"nth": ordered.total(F.lit(1))}, by, reverse).scan({"twice": ordered.total(F.col("s"))}, reverse=reverse)
    assert len({r[0] for r in out.rows.select("_part").distinct().collect()}) > 8
    got = by_id(out.result(), *scans, "nth", "twice")
    for c in (1, 2, None):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[2], r[1]), reverse=reverse)
        twice = 0
        for i, r in enumerate(own):
            upto = [x[3] for x in own[: i + 1]]
            known = [x for x in upto if x is not None]
            before = [x for x in upto[:-1] if x is not None]
            want = {"s": sum(known), "sb": sum(before), "m": max(known, default=None), "mb": max(before, default=None), "p": upto[-2] if i else None, "f": upto[0]}
            twice += sum(known)
            assert got[r[1]] == (*[want[k] for k in scans], upto.count(r[3]), twice)


def test_packs_do_not_depend_on_ranges(spark, sf):
    """All features in one range and in many, over customers that reach over several ranges."""
    t = S.with_time(C.events(spark, sf)).filter("customer_id < 12").withColumn("customer_id", F.when(F.col("customer_id") > 3, 7).otherwise(F.col("customer_id")))
    for make in (lambda n: prefix.sequence_first(t, cap=20, ultra_burst=True, parts=n), lambda n: prefix.sequence_first(t, parts=n), lambda n: prefix.baseline_pack(t, n), lambda n: sequences.count_windows(t, 16, 4, 8, n)):
        one, many = (sorted(map(str, make(n).collect())) for n in (1, 9))
        assert len(one) > 100 and one == many


def seconds_of(spark, n):
    """Of all windows of one customer whose ``n`` events lie in one week."""
    df = spark.range(n).select(F.lit(1).alias("customer_id"), F.col("id").alias("event_id"), (F.col("id") * 7919 % 604_800).alias("event_ts"), (F.col("id") % 1000).alias("amt"))
    began = time.time()
    t = timeline(df, {w: ("x",) for w in (600, 3600, 86_400, 604_800)}, {"x": F.col("amt")}, parts=8)
    out = t.over(86_400, {"s1": "x"}).over(604_800, {"s7": "x"}, {"m7": "x"}).with_columns_of({"n": t.count(604_800)}).result()
    n_rows, top = out.agg(F.count("*"), F.max("n")).first()
    assert n_rows == top == n
    return time.time() - began


def test_a_customer_with_very_many_events_takes_time_in_proportion(spark):
    seconds_of(spark, 5_000)
    few, many = seconds_of(spark, 50_000), seconds_of(spark, 200_000)
    print(f"50,000 events {few:.1f} s, 200,000 events {many:.1f} s")
    assert many < 5 * few


def test_amount_edges(spark):
    values = [None, 0.0, -0.5, -1.0, -5.0, 1e9, float("nan")]
    df = spark.createDataFrame([(i, "2024-01-01 00:00:00", v) for i, v in enumerate(values)], "event_id long, event_dttm string, operaton_amt double")
    got = by_id(S.with_time(df).withColumn("b", S.amount_bucket()), "is_zero_amt", "b")
    assert [got[i][0] for i in range(6)] == [1, 1, 0, 0, 0, 0]
    assert [got[i][1] for i in range(7)] == [0, 0, 0, -1, -1, 4, -1]


def test_bad_times_and_weekend(spark):
    texts = [None, "", "2024-13-01 00:00:00", *[f"2024-01-0{d} 23:59:59" for d in range(1, 8)]]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "event_id long, event_dttm string, operaton_amt double")
    got = by_id(S.with_time(df), "event_ts", "is_weekend", "event_weekday")
    assert all(got[i][0] is None for i in range(3))
    assert [got[i][1] for i in range(3, 10)] == [0, 0, 0, 0, 1, 1, 0]
    other = by_id(S.with_time(df, weekend=(6, 7)), "is_weekend")
    assert [other[i] for i in range(3, 10)] == [0, 0, 0, 0, 0, 1, 1]


def test_battery(spark):
    texts = ["5", "20", "20.5", "100", "101", "x", None, " 12 ", "1d", "85%"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "event_id long, battery string")
    got = by_id(df.withColumn("b", S.battery_bucket(S.battery_level())), "b")
    assert [got[i] for i in range(10)] == [0, 1, 2, 3, 4, -1, -1, 1, -1, -1]


def test_session_fallback(spark):
    df = spark.createDataFrame([(1, 1, 100, "unknown"), (1, 2, 1799, None), (1, 3, 1800, " 0"), (1, 4, 1801, "0"), (1, 5, 1900, "s")], "customer_id long, event_id long, event_ts long, session_id string")
    got = by_id(df.withColumn("k", S.session_key()), "k")
    assert got == {1: "__30m__0", 2: "__30m__0", 3: " 0", 4: "__30m__1", 5: "s"}


def risk_rows(n=400, seed=1):
    rng = random.Random(seed)
    return [(rng.randrange(6), i, rng.randrange(0, 4 * 86_400, 3600), rng.choice(["a", "b", None]), rng.choice([1, 0, -1, -1])) for i in range(n)]


RISK = "customer_id long, event_id long, event_ts long, mcc_code string, target int"
KEYS = risk.KEYS["mcc"]
NAME = risk.prefix_name(KEYS)
OUT = [f"{NAME}_{x}" for x in ("cnt_prev", "is_new", "tslast_sec", "pos_prev", "risk_smooth")]


def naive_risk(rows, labeled_only=True, alpha=20.0, prior=0.5, start=None, total=(0, 0)):
    state = defaultdict(lambda: [0, 0, None], {k: list(v) for k, v in (start or {}).items()})
    n, p = total
    out = {}
    for c, e, t, m, y in sorted(rows, key=lambda r: (r[2], r[1])):
        s = state[(c, m)]
        now = p / n if n else prior
        out[e] = (s[0], int(s[0] == 0), -1 if s[2] is None else t - s[2], s[1], (s[1] + alpha * now) / (s[0] + alpha))
        if y >= 0 or not labeled_only:
            s[0], s[1], s[2] = s[0] + 1, s[1] + (y == 1), t
            n, p = n + 1, p + (y == 1)
    return out, state, (n, p)


def same(got, want):
    return got.keys() == want.keys() and all(g[:4] == w[:4] and abs(g[4] - w[4]) < 1e-12 for g, w in ((got[k], want[k]) for k in want))


@pytest.mark.parametrize("parts", [None, 9])
@pytest.mark.parametrize("labeled_only", [True, False])
def test_risk_train(spark, labeled_only, parts):
    rows = risk_rows()
    got = by_id(risk.online_risk(small(spark, rows, RISK), [KEYS], labeled_only=labeled_only, parts=parts), *OUT)
    assert same(got, naive_risk(rows, labeled_only)[0])


def test_risk_warm_and_frozen(spark):
    early, late = risk_rows(200, 2), [(c, e + 1000, t + 9 * 86_400, m, y) for c, e, t, m, y in risk_rows(150, 3)] + [(99, 5000, 10 * 86_400, "unseen", 1)]
    state = risk.fit_state(small(spark, early, RISK), KEYS, alpha=5.0)
    _, s, total = naive_risk(early, alpha=5.0)
    warm = by_id(risk.online_risk(small(spark, late, RISK), [KEYS], state={NAME: state}, alpha=77.0), *OUT)
    assert same(warm, naive_risk(late, alpha=5.0, start=s, total=total)[0])
    frozen = by_id(risk.online_risk(small(spark, late, RISK), [KEYS], mode="valid", state={NAME: state}), *OUT)
    for c, e, t, m, _ in late:
        n, p, last = s.get((c, m), (0, 0, None))
        want = (n, int(n == 0), -1 if last is None else t - last, p, (p + 5.0 * total[1] / total[0]) / (n + 5.0))
        assert same({e: frozen[e]}, {e: want})
    with pytest.raises(ValueError):
        risk.online_risk(small(spark, late, RISK), [KEYS], mode="other")


def test_risk_does_not_leak(spark):
    rows = risk_rows(120)
    base = by_id(risk.online_risk(small(spark, rows, RISK), [KEYS]), *OUT)
    i = next(i for i, r in enumerate(sorted(rows, key=lambda r: (r[2], r[1]))) if r[4] >= 0 and i > 40)
    row = sorted(rows, key=lambda r: (r[2], r[1]))[i]
    flipped = [r[:4] + (1 - r[4],) if r is row else r for r in rows]
    assert by_id(risk.online_risk(small(spark, flipped, RISK), [KEYS]), *OUT)[row[1]] == base[row[1]]
    past = [r for r in rows if (r[2], r[1]) <= (row[2], row[1])]
    cut = by_id(risk.online_risk(small(spark, past, RISK), [KEYS]), *OUT)
    assert all(cut[e] == base[e] for e in cut)
    assert all(0 <= v[4] <= 1 and v[0] >= 0 for v in base.values())


def test_full_pack_is_causal_and_order_free(spark, sf):
    t = S.with_time(C.events(spark, sf)).filter("customer_id < 6")
    full = {r.event_id: r for r in prefix.sequence_first(t, cap=20, ultra_burst=True).collect()}
    mid = t.selectExpr("percentile(event_ts, 0.5)").first()[0]
    part = prefix.sequence_first(t.filter(F.col("event_ts") <= mid).orderBy(F.rand(3)), cap=20, ultra_burst=True).collect()
    assert len(part) > 50 and all(full[r.event_id] == r for r in part)


def test_average_precision(spark):
    tied = [("t", 1, 0.9, 1), ("t", 2, 0.9, 0), ("t", 3, 0.5, 1), ("t", 4, 0.1, 0)]
    df = spark.createDataFrame([*tied, ("none", 5, 0.2, 0), ("none", 6, 0.1, -1), ("all", 7, 0.2, 1), ("all", 8, 0.1, 1)], "g string, event_id long, score double, target int")
    got = {r.g: r.average_precision for r in E.average_precision(df, ["g"]).collect()}
    assert math.isclose(got["t"], 0.5 * 0.5 + 0.5 * (2 / 3)) and got["none"] == 0.0 and got["all"] == 1.0
    top = {(r.g, r.k): r.recall for r in E.recall_at(df, ["g"], [1, 10]).collect()}
    assert top[("t", 1)] == 0.5 and top[("t", 10)] == 1.0 and top[("none", 1)] == 0.0


def test_folds_need_weeks(spark, sf):
    with pytest.raises(ValueError):
        E.rolling_week_folds(S.with_time(C.events(spark, sf)), 4, 8)


@pytest.mark.parametrize(("length", "stride", "least"), [(128, 32, 8), (16, 4, 8), (10, 15, 3)])
def test_count_windows(spark, length, stride, least):
    sizes = [7, 8, 128, 129, 160, 161]
    rows = [(c, c * 1000 + i, i * 10, 1, 2) for c, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "customer_id long, event_id long, event_ts long, event_type_nm int, channel_indicator_sub_type int")
    got = {(r.customer_id, r.w): list(r.event_id) for r in sequences.count_windows(df, length, stride, least).collect()}
    want = {}
    for c, n in enumerate(sizes):
        w = 0
        while n >= least:
            own = [c * 1000 + i for i in range(w * stride, min(n, w * stride + length))]
            if len(own) >= least:
                want[(c, w)] = own
            if w * stride + length >= n:
                break
            w += 1
    assert got == want


def test_masking(spark, sf):
    w = sequences.count_windows(S.with_time(C.events(spark, sf)), 16, 8, 8)
    rows = sequences.mask_tokens(w, 9).collect()
    again = {(r.customer_id, r.w): r.masked_event for r in sequences.mask_tokens(w, 9).collect()}
    hit = total = 0
    for r in rows:
        chosen = [i for i, x in enumerate(r.mlm_label) if x != sequences.IGNORE]
        assert chosen and all(r.mlm_label[i] == r.event_token[i] for i in chosen)
        assert all(m == e for i, (m, e) in enumerate(zip(r.masked_event, r.event_token, strict=True)) if i not in chosen)
        assert again[(r.customer_id, r.w)] == r.masked_event
        hit, total = hit + len(chosen), total + r.size
    assert 0.12 < hit / total < 0.2
    assert all(r.masked_event == r.event_token for r in sequences.mask_tokens(w, 9, share=0.0).limit(50).collect())


def test_padding_and_hidden(spark):
    df = spark.createDataFrame([(1, i, i, 0, 1) for i in range(9)], "customer_id long, event_id long, event_ts long, event_type_nm int, channel_indicator_sub_type int")
    p = sequences.pad_windows(sequences.count_windows(df, 12, 4, 8), 12)
    r = p.first()
    assert len(r.event_token) == 12 and r.event_token[9:] == [0, 0, 0] and sum(r.attention_mask) == 9 and r.event_id[-1] == -1
    hidden = p.withColumn("hidden", F.transform("event_token", lambda x: F.array(x.cast("double"), F.lit(1.0))))
    flat = sequences.flatten_hidden(hidden)
    assert flat.count() == 9
    assert sequences.pooled_vectors(sequences.mean_pool(flat, "customer_id", "vector"), "customer_id").first().vector == [3.0, 1.0]


def test_profile_edges(spark):
    df = spark.createDataFrame([(1, 10, "2024-01-01", 5.0, None), (2, 20, "2024-01-01", 1.0, "a"), (2, 30, "2024-01-02", None, None)], "customer_id long, event_ts long, event_date string, operaton_amt double, mcc_code string")
    for c in profile.COUNTED:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(1))
    got = {r.customer_id: r for r in profile.customer_profile(df).collect()}
    assert got[1].pre_std_amt == 0.0 and got[1].pre_n_mcc_code == 1 and got[2].pre_n_mcc_code == 2
    events = spark.createDataFrame([(1, 1, 100), (3, 2, 100)], "customer_id long, event_id long, event_ts long")
    gap = by_id(profile.join_profile(events, profile.customer_profile(df)), "gap_from_pretrain_last_sec")
    assert gap == {1: 90, 2: 100}


def test_unknown_category(spark):
    a = spark.createDataFrame([(3, "x"), (1, "y"), (2, None)], "event_id long, c string")
    codes = encode.fit_categories(a, ["c"])
    assert {r.value: r.code for r in codes.collect()} == {"y": 0, "<NULL>": 1, "x": 2}
    b = spark.createDataFrame([(1, "new"), (2, "x")], "event_id long, c string")
    assert by_id(encode.encode_categories(b, codes, ["c"]), "c_code") == {1: -1, 2: 2}


@pytest.mark.parametrize("values", [100_000, 6])
def test_one_dictionary_for_all_columns(spark, monkeypatch, values):
    """Frequent values in one expression, the rest in one long join; at most two joins in the plan."""
    monkeypatch.setattr(encode, "DICTIONARY_VALUES", values)
    long = "z" * 100
    rows = [(i, "hot" if i % 3 else f"v{i}", None if i % 5 == 0 else f"w{i % 4}", long if i == 7 else "x") for i in range(200)]
    columns = ["a", "b", "c"]
    fit, apply = (spark.createDataFrame(x, "event_id long, a string, b string, c string") for x in (rows[:150], rows))
    codes = encode.fit_categories(fit, columns)
    known = {(r.col, r.value): r.code for r in codes.collect()}
    out = encode.encode_categories(apply, codes, columns)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") - plan.count("Join LeftOuter, (id") <= 2
    for r in out.collect():
        for c in columns:
            assert r[f"{c}_code"] == known.get((c, r[c] if r[c] is not None else "<NULL>"), -1)
    assert out.columns == [*apply.columns, "a_code", "b_code", "c_code"] and out.count() == 200


@pytest.mark.parametrize("parts", [None, 9])
def test_ordered_targets(spark, parts):
    """Against a plain loop in the order of the hash; a row's own label never counts; unseen values are at the prior."""
    rng = random.Random(6)
    rows = [(i, rng.choice(["hot", "hot", "b", None, f"r{i}"]), rng.choice(["x", "y"]), rng.choice([1, 0, 0, -1])) for i in range(400)] + [(7, "hot", "x", 1), (7, "hot", "x", 1)]
    df = small(spark, rows, "event_id long, a string, b string, target int")
    order = {r[0]: r[1] for r in df.select("event_id", F.xxhash64(F.lit(42), "event_id")).collect()}
    got = sorted(tuple(r) for r in encode.ordered_targets(df, ["a", "b"], alpha=2.0, parts=parts).select("event_id", "target", "a_target", "b_target").collect())
    seen, want = defaultdict(lambda: [0, 0]), []
    for e, a, b, y in sorted((r for r in rows if r[3] >= 0), key=lambda r: (order[r[0]], r[0], r[3])):
        states = [seen["a", a], seen["b", b]]
        want.append((e, y, *[(p + 2.0 * 0.5) / (n + 2.0) for n, p in states]))
        for s in states:
            s[0], s[1] = s[0] + 1, s[1] + y
    assert len(got) == len(want) and all(g[:2] == w[:2] and abs(g[2] - w[2]) + abs(g[3] - w[3]) < 1e-12 for g, w in zip(got, sorted(want), strict=True))
    one = next(r for r in rows if r[3] >= 0 and r[0] != 7)
    flipped = small(spark, [(*r[:3], 1 - r[3]) if r is one else r for r in rows], "event_id long, a string, b string, target int")
    own = lambda d: encode.ordered_targets(d, ["a", "b"]).filter(F.col("event_id") == one[0]).select("a_target", "b_target").collect()
    assert own(df) == own(flipped)
    new = small(spark, [(1, "hot", "z"), (2, None, "x")], "event_id long, a string, b string")
    made = by_id(encode.apply_targets(new, encode.fit_targets(df, ["a", "b"], alpha=2.0), ["a", "b"]), "a_target", "b_target")
    rate = lambda k: (seen[k][1] + 1.0) / (seen[k][0] + 2.0)
    assert made[1] == (pytest.approx(rate(("a", "hot"))), 0.5) and made[2] == (pytest.approx(rate(("a", None))), pytest.approx(rate(("b", "x"))))


def test_profile_plan_has_no_expand(spark, sf):
    plan = profile.customer_profile(S.with_time(C.events(spark, sf)))._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan


def test_submission_order_and_quantiles(spark):
    expected = spark.createDataFrame([(i, i) for i in range(10)], "event_id long, row_no long")
    for shift, want in ((0, 1), (1, 0)):
        s = spark.createDataFrame([((i + shift) % 10, i / 10, i) for i in range(10)], "event_id long, predict double, row_no long")
        got = {r.check_name: r for r in E.submission_checks(s, expected).collect()}
        assert got["same_order"].detail == want and got["same_order"].status == "info"
        assert abs(got["score_q90"].value - 0.81) < 1e-9 and abs(got["score_mean"].value - 0.45) < 1e-9 and got["spread"].status == "ok"
    flat = spark.createDataFrame([(i, 0.5 + i * 1e-10) for i in range(10)], "event_id long, predict double")
    got = {r.check_name: r for r in E.submission_checks(flat, expected).collect()}
    assert got["spread"].status == "warn" and got["same_order"].detail is None


def test_prior_without_labels(spark):
    df = spark.createDataFrame([(1, -1)], "event_id long, target int")
    assert risk.weighted_prior(df).first().prior == 0.5
