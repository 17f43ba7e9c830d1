"""Supervised targets: any cut of the rows gives the same, and no path and no wide row travels."""

import datetime as dt

import numpy as np
import pytest

from chronoframe.operators import targets as T


def levels(spark):
    rng = np.random.default_rng(2)
    rows = [(e, dt.date(2000, 1, 1) + dt.timedelta(k), float(x)) for e, size in ((1, 60), (2, 60), (3, 4)) for k, x in enumerate(np.exp(np.cumsum(rng.normal(0, 0.03, size)))) if e != 2 or k % 7]
    return rows, spark.createDataFrame(rows, "entity int, d date, level double")


def test_paths_and_ranks_by_hand_in_small_batches(spark):
    rows, df = levels(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(key)
    spark.conf.set(key, 5)
    try:
        got = {(r.entity, r.d, r.horizon): r for r in T.supervised(df, (1, 5, 20)).collect()}
    finally:
        spark.conf.set(key, usual)
    want = {}
    for e in (1, 2, 3):
        own = [(d, x) for i, d, x in rows if i == e]
        for k, (d, x) in enumerate(own):
            for h in (1, 5, 20):
                if k + h < len(own):
                    want[e, d, h] = own[k + h][0], np.array([y for _, y in own[k:k + h + 1]])
    assert got.keys() == want.keys()
    for k, (end, path) in want.items():
        r, p = got[k], path[1:] / path[0] - 1
        same = [want[j][1][-1] / want[j][1][0] - 1 for j in want if j[1:] == k[1:]]
        assert (r.exit_date, r.time_to_high, r.time_to_low, r.eligible_count) == (end, p.argmax() + 1, p.argmin() + 1, len(same))
        assert r.total_return == pytest.approx(p[-1]) and r.mfe == pytest.approx(p.max()) and r.mae == pytest.approx(p.min())
        assert r.max_drawdown == pytest.approx((path / np.maximum.accumulate(path) - 1).min()) and r.realised_vol == pytest.approx(np.diff(np.log(path)).std() * 252**0.5, abs=1e-12)
        assert r.percentile_rank == pytest.approx(sum(x <= p[-1] for x in same) / len(same)) and r.excess_median == pytest.approx(p[-1] - np.median(same))


def test_no_path_is_collected(spark):
    """A list of up to 250 levels a row and horizon was made, and whole rows were dealt by date."""
    plan = T.supervised(levels(spark)[1])._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "median(" not in plan
