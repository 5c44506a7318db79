"""The stream of edges: order within the delay, frozen priors, restart."""

import random
from collections import defaultdict

from causeway.operators import risk
from causeway.streaming import risk as online

KEYS = risk.KEYS["mcc"]
SCHEMA = "customer_id long, mcc_code string, event_id long, event_ts long, target int"


def test_out_of_order_and_restart(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randrange(3), rng.choice(["a", None]), i, 9_000 + 60 * (i // 3), rng.choice([1, 0, -1])) for i in range(240)]
    # Each file is shuffled, and some rows come with the next one; a late last row lets the watermark pass all others.
    files = [rows[:100], rows[100:170], rows[170:] + [(9, "end", 999, 10**6, -1)]]
    folder, inputs = str(tmp_path / "out"), tmp_path / "in"
    read = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(inputs)).selectExpr("*", "timestamp_seconds(event_ts) as event_dt")

    def put(n: int) -> None:
        own = list(files[n])
        rng.shuffle(own)
        spark.createDataFrame(own, SCHEMA).coalesce(1).write.mode("append").json(str(inputs))

    put(0)
    swapped = files[1][60:65]  # these come with the third file, and are still within the delay
    files[1] = files[1][:60] + files[1][65:]
    files[2] = files[2] + swapped
    put(1)
    first = online.run_online_risk(read(), KEYS, folder, late="20 minutes")
    some = first.count()
    put(2)
    got = online.run_online_risk(read(), KEYS, folder, late="20 minutes").collect()
    again = online.run_online_risk(read(), KEYS, folder, late="20 minutes")
    assert again.count() == len(got) == len({r.event_id for r in got}) == 240 and 0 < some < 240
    state = defaultdict(lambda: (0, 0, None))
    want = {}
    for c, m, e, t, y in sorted(rows, key=lambda r: (r[3], r[2])):
        n, p, last = state[c, m]
        want[e] = (n, p, -1 if last is None else t - last, int(n == 0))
        if y >= 0:
            state[c, m] = (n + 1, p + (y == 1), t)
    assert {r.event_id: (r.cnt_prev, r.pos_prev, r.tslast_sec, r.is_new) for r in got} == want
    epochs = sorted({r.epoch for r in got})
    assert len(epochs) >= 2
    for r in got:
        seen = [x for x in got if x.epoch < r.epoch and x.target >= 0]
        prior = sum(x.target for x in seen) / len(seen) if seen else 0.5
        assert abs(r.prior - prior) < 1e-12 and abs(r.risk_smooth - (r.pos_prev + 20 * prior) / (r.cnt_prev + 20)) < 1e-12


def test_many_micro_batches_without_python(spark, tmp_path):
    """Seven micro-batches, some without labeled rows, on top of what the earlier ones left; no executor runs Python for it."""
    rng = random.Random(7)
    files = [[(rng.randrange(4), rng.choice(["a", "b", None]), 100 * k + i, 10_000 * (k + 1) + i // 2, -1 if k == 3 else rng.choice([1, 0, -1])) for i in range(60)] for k in range(6)]
    files.append([(9, "end", 999, 10**6, -1)])
    for k, own in enumerate(files):
        spark.createDataFrame(own, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        if k == 2:
            online.run_online_risk(read_one_by_one(spark, tmp_path), KEYS, str(tmp_path / "out"), late="1 minute")
    got = online.run_online_risk(read_one_by_one(spark, tmp_path), KEYS, str(tmp_path / "out"), late="1 minute").collect()
    state, want = defaultdict(lambda: (0, 0, None)), {}
    for c, m, e, t, y in sorted((r for own in files[:-1] for r in own), key=lambda r: (r[3], r[2])):
        n, p, last = state[c, m]
        want[e] = (n, p, -1 if last is None else t - last, int(n == 0))
        if y >= 0:
            state[c, m] = (n + 1, p + (y == 1), t)
    assert len(got) == 360 and {r.event_id: (r.cnt_prev, r.pos_prev, r.tslast_sec, r.is_new) for r in got} == want
    last = max(r.epoch for r in got)
    assert len({r.epoch for r in got}) >= 6 and last >= 6
    # Few tables hold all edges, and each is of as many micro-batches as it says.
    edges = spark.read.schema("_customer_id string, _mcc_code string, cnt_prev long, pos_prev long, _last long").parquet(*[f"{tmp_path}/out/edges/upto={k}" for k in online.tables(last + 1)])
    assert len([*online.tables(last + 1)]) <= 3 and sum(r.cnt_prev for r in edges.collect()) == sum(n for n, _, _ in state.values())
    plan = online.passed_rows(read_one_by_one(spark, tmp_path), KEYS)._jdf.queryExecution().toString().lower()
    assert "collect_list" in plan and "python" not in plan and "pyspark" not in plan and "transformwithstate" not in plan


def read_one_by_one(spark, tmp_path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).selectExpr("*", "timestamp_seconds(event_ts) as event_dt")
