"""The standard features in batches: any cut of the rows gives the same values, and no window holds a list a row."""

import datetime as dt
import math

import numpy as np

from chronoframe.operators import features as X


def frames(spark):
    rng = np.random.default_rng(1)
    rows = []
    for e, size in ((1, 700), (2, 3), (3, 300)):
        close = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, size)))
        rows += [(e, dt.date(2000, 1, 1) + dt.timedelta(k), None if e == 3 and k == 10 else float(x), None if k % 40 == 7 else float(rng.uniform(1, 9)), float(k % 3)) for k, x in enumerate(close)]
    bench = [(dt.date(2000, 1, 1) + dt.timedelta(k), float(40 + k % 11)) for k in range(650)]
    return spark.createDataFrame(rows, "entity int, d date, close double, value double, volume double"), spark.createDataFrame(bench, "d date, close double")


def test_any_cut_of_the_rows_gives_the_same(spark):
    prices, bench = frames(spark)
    found, key = [], "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(key)
    try:
        for size in (7, 10_000):
            spark.conf.set(key, size)
            found.append({(r.entity, r.d): r for r in X.standard(prices, bench).collect()})
    finally:
        spark.conf.set(key, usual)
    a, b = found
    assert len(a) == 1003 and a.keys() == b.keys()
    for k in a:
        for x, y in zip(a[k][5:], b[k][5:]):
            assert (x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12)), k
    assert a[1, dt.date(2000, 1, 1) + dt.timedelta(400)].max_drawdown_250 is not None and a[3, dt.date(2000, 1, 11)].return_1 is None


def test_no_row_recomputes_its_windows_in_a_list(spark):
    plan = X.standard(*frames(spark))._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "percentile" not in plan


def test_a_benchmark_that_does_not_vary_has_no_beta(spark):
    prices, bench = frames(spark)
    r = X.standard(prices, bench.selectExpr("d", "40.0D AS close")).where("entity = 1").orderBy("d").collect()[600]
    assert r.beta_60 is None and r.correlation_250 is None and r.volatility_60 > 0


def test_scores_take_features_and_outcomes_from_one_shuffle(spark, tmp_path):
    """The features, all of them, were dealt by entity and day again to meet the outcomes; a null entity has no row."""
    from chronoframe.catalog import QUERIES

    rows = [(e, k, 1, dt.datetime(2000, 1, 1) + dt.timedelta(k), 10.0 + k % 7, 2.0) for k in range(40) for e in (1, 2, None)]
    spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_linenumber int, l_shipdate timestamp, l_extendedprice double, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    scores = QUERIES["score_blocks"](spark, str(tmp_path))
    assert scores._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(entity#") == 1
    assert sorted({(r.entity, r.n) for r in scores.collect()}) == [(e, n) for e in (1, 2) for n in range(21)]
