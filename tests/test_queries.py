"""Every query against its SQL in DuckDB; those without SQL have tests of their own."""

import re

import oracle
import pytest

from causeway.plans.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, sf, name):
    assert oracle.difference(spark, duck, QUERIES[name], ORACLE[name], sf) == ""


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() == 1000
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_caps_bind(spark, sf):
    for n in (5, 20):
        assert QUERIES[f"rolling_capped_{n}"](spark, sf).filter("bound = 1").count() > 100


@pytest.mark.parametrize("name", ["gbt_scores", "second_order_scores"])
def test_model_ranks_reds_high(spark, sf, name):
    rows = QUERIES[name](spark, sf).filter("target >= 0").collect()
    red = [r.probability_red for r in rows if r.target == 1]
    yellow = [r.probability_red for r in rows if r.target == 0]
    assert sum(red) / len(red) > sum(yellow) / len(yellow) + 0.1
    assert all(abs(r.sigmoid - 1 / (1 + 2.718281828459045 ** -r.margin)) < 1e-9 for r in rows)


WINDOWED = ["rolling_counts", "rolling_capped_5", "rolling_ties_lineitem", "session_prefix", "fingerprint_history", "gap_features", "novelty_flags", "battery_features", "device_tz_lang_drift", "baseline_pack", "sequence_first_pack", "sequence_windows", "risk_train_mcc"]


@pytest.mark.parametrize("name", WINDOWED)
def test_no_task_sees_a_whole_customer(spark, sf, name):
    """Windows run inside pieces, or over what is carried from piece to piece: none takes a customer's rows or all rows."""
    df = QUERIES[name](spark, sf)
    specs = re.findall(r"windowspecdefinition\((.*?), specifiedwindowframe", df._jdf.queryExecution().optimizedPlan().toString())
    assert specs and all(s.startswith("_part#") or re.search(r" _part#\d+ (ASC|DESC)", s) for s in specs), specs
    assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()
