"""Definitions worked by hand: the numbers here come from the rules' text, not from the operators."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoframe.operators import analogs as A
from chronoframe.operators import context as C
from chronoframe.operators import events as E
from chronoframe.operators import features as X
from chronoframe.operators import finance as Fi
from chronoframe.operators import models as M
from chronoframe.operators import panel as P
from chronoframe.operators import portfolio as Po
from chronoframe.operators import quality as Q
from chronoframe.operators import rules as R
from chronoframe.operators import scoring as Sc
from chronoframe.operators import stats as S
from chronoframe.operators import targets as T
from chronoframe.operators import windows as W
from chronoframe.sources import sinks

D0 = dt.date(2024, 1, 1)


def day(n):
    return D0 + dt.timedelta(n)


def panel(spark, closes, entity=1):
    rows = [(entity, day(k), float(c), 100.0 * float(c), 10.0, 4) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, "entity int, d date, close double, value double, volume double, trades int")


def test_standard_features_against_numpy(spark):
    r = np.random.default_rng(0)
    close = 100 * np.exp(np.cumsum(r.normal(0, 0.02, 300)))
    bench = 50 * np.exp(np.cumsum(r.normal(0, 0.01, 300)))
    b = spark.createDataFrame([(day(k), float(c)) for k, c in enumerate(bench)], "d date, close double")
    got = X.standard(panel(spark, close), b).orderBy("d").collect()
    assert len(got[0]) == 6 + 43
    last, ret, br = got[-1], close[1:] / close[:-1] - 1, bench[1:] / bench[:-1] - 1
    near = lambda x, y: math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12)
    assert near(last.return_250, close[-1] / close[-251] - 1) and near(last.sma_100, close[-100:].mean())
    assert near(last.sma_200_slope, close[-200:].mean() / close[-205:-5].mean() - 1)
    assert near(last.volatility_60, ret[-60:].std(ddof=1) * math.sqrt(252))
    neg = ret[-60:][ret[-60:] < 0]
    assert near(last.downside_volatility_60, neg.std(ddof=1) * math.sqrt(252))
    year = close[-250:]
    assert near(last.range_52w_position, (close[-1] - year.min()) / (year.max() - year.min())) and near(last.distance_to_52w_high, close[-1] / year.max() - 1)
    assert near(last.max_drawdown_250, (year / np.maximum.accumulate(year) - 1).min())
    assert near(last.turnover_median_60, np.median(100 * close[-60:])) and last.zero_volume_days_20 == 0
    assert near(last.relative_strength_120, (close[-1] / close[-121]) / np.prod(1 + br[-120:]) - 1)
    assert near(last.beta_250, np.cov(ret[-250:], br[-250:])[0, 1] / br[-250:].var(ddof=1)) and near(last.correlation_60, np.corrcoef(ret[-60:], br[-60:])[0, 1])
    assert got[249].beta_250 is None and got[250].beta_250 is not None and got[198].sma_200 is None and got[198].sma_50_above_200 == 0.0


def test_days_vs_the_mean_count_from_equality(spark):
    got = X.standard(panel(spark, [10.0] * 200 + [10.0, 9.0, 11.0])).orderBy("d").collect()
    assert [r.days_vs_sma_200 for r in got[198:]] == [-1, 1, 2, -1, 1]


def test_targets_of_one_path(spark):
    levels = panel(spark, [100.0, 104.0, 96.0, 109.0]).withColumnRenamed("close", "level")
    bench = spark.createDataFrame([(day(0), 10.0), (day(3), 10.9)], "d date, level double")
    got = {(r.d, r.horizon): r for r in T.supervised(levels, (1, 3), bench).collect()}
    assert len(got) == 4
    x = got[day(0), 3]
    assert math.isclose(x.total_return, 0.09) and math.isclose(x.excess_benchmark, 0.0, abs_tol=1e-12) and (x.mfe, x.time_to_high, x.time_to_low) == (pytest.approx(0.09), 3, 2)
    assert x.mae == pytest.approx(-0.04) and x.max_drawdown == pytest.approx(96 / 104 - 1) and x.calmar == pytest.approx(0.09 / (1 - 96 / 104)) and x.return_over_downside == pytest.approx(2.25)
    steps = np.log([104 / 100, 96 / 104, 109 / 96])
    assert x.realised_vol == pytest.approx(steps.std() * math.sqrt(252)) and x.path_shape == "high_volatility"  # steps vary by over 0.04
    assert x.move_up_5 and not x.move_up_10 and not x.move_down_3 and x.percentile_rank == 1.0 and x.excess_median == 0.0
    assert got[day(1), 1].excess_benchmark is None and got[day(0), 1].realised_vol == 0.0 and got[day(0), 1].return_over_vol is None


def test_entries_by_delay_and_dip(spark):
    levels = panel(spark, [100.0, 99.0, 97.5, 103.0, 105.0]).withColumnRenamed("close", "level")
    got = {r.policy: r for r in T.entries(levels, (4,)).collect()}
    assert set(got) == {*T.DELAYS, *T.DIPS}
    assert got["BUY_NOW"].policy_return == pytest.approx(105 / 99 - 1) and got["BUY_NOW"].missed_return == 0.0
    assert got["WAIT_3"].entry_price == 103.0 and got["WAIT_10"].entry_date == day(4) and got["WAIT_10"].policy_return == 0.0
    dip = got["BUY_AFTER_DIP_2"]
    assert (dip.entry_price, dip.entry_date, dip.entered) == (97.5, day(2), True) and dip.entry_improvement == pytest.approx(1 - 97.5 / 99)
    no = got["BUY_AFTER_DIP_3"]
    assert not no.entered and no.policy_return is None and no.missed_return == pytest.approx(105 / 99 - 1) and no.threshold == pytest.approx(97.0)


def test_quadrants_and_scores():
    rules = dict((c, x) for c, x in R.QUADRANT)
    assert rules["high AND calm"] == "high_opportunity_low_downside" and R.QUADRANT_ELSE == "low_opportunity_high_downside"
    assert math.isclose(sum(R.BLOCK_WEIGHT.values()), 1.0)


def test_fundamental_confidence_of_one_issuer(spark):
    row = spark.createDataFrame([(8, 10, 70, True, False, 4, 3, True, 5.0, 6, 0.25, 1, True)], "key_metrics int, total_key_metrics int, age_days int, has_ifrs boolean, has_ras boolean, consistency_checks int, consistency_passed int, has_shares boolean, history_years double, validated_releases int, manual_ratio double, ambiguities int, stable_methodology boolean")
    got = Sc.fundamental_confidence(row).first()
    # 0.3 * 80 + 0.15 * 90 + 0.2 * 68 + 0.2 * 75 + 0.15 * 80 - 20
    assert got.data_confidence == 58.1 and got.valuation_confidence == 49.4 and got.backtest_confidence == 46.5


def test_gates_name_what_is_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0, 10.0, 0, "", "2024-03-01", "OLD", "NEW", 1.0, True), (1.0, 2.0, 10.0, 1, "RUB", "2024-03-01", "", "NEW", -1.0, False)], "spot_scale double, futures_scale double, multiplier double, lot int, currency string, expiration string, old string, new string, conversion double, legal boolean")
    got = df.select(Sc.missing_fields(*Sc.FUTURES_UNITS).alias("m"), Sc.identity_gate("old", "new", "conversion", "legal").alias("e")).collect()
    assert got[0].m == ["lot", "currency"] and got[0].e == [] and got[1].m == []
    assert got[1].e == ["both SECID required", "positive conversion ratio required", "legal continuity evidence required"]


def test_quality_policy_score(spark):
    row = spark.createDataFrame([(5.0, 700, 0.05, 0.8, 0.6, 1, 2, 4, 1)], "years double, observations int, missing double, volume_coverage double, trade_coverage double, boards int, periods int, episodes int, resolved int")
    got = Sc.quality_policy(row).first()
    # 20*.5 + 15*.95 + 15*.8 + 10*.6 + 10*1 + 15*.25 + 10*.8 + 5*.4
    assert got.score == pytest.approx(66.0) and got.tier == "B" and got.reason is None and got.unresolved == 3


def test_reaction_runs_from_the_anchor(spark):
    prices = panel(spark, [50.0, 100.0, 110.0, 99.0]).select("entity", "d", "close")
    market = spark.createDataFrame([(day(k), c) for k, c in enumerate([1.0, 1.0, 1.05, 1.02])], "d date, close double")
    events = spark.createDataFrame([(7, 1, day(1), 2, True)], "event_id int, entity int, event_d date, same_day_events int, dividend_day boolean")
    got = {r.horizon: r for r in E.reactions(prices, market, events, (0, 1, 2, 5)).collect()}
    assert set(got) == {0, 1, 2} and got[0].raw == 0.0 and got[1].raw == pytest.approx(0.10) and got[1].abnormal == pytest.approx(0.05)
    x = got[2]
    assert x.max_gain == pytest.approx(0.10) and x.max_drawdown == pytest.approx(-0.01) and x.sessions_to_max == 1 and x.volatility == pytest.approx(np.std([0.1, 99 / 110 - 1])) and x.confounding == "heavily_confounded"


def test_sequence_size_stops_at_the_first_gap(spark):
    x = [1.0, 2.0, 3.0, 4.0, 3.0, 2.0, 1.0, 2.0, 3.0, 4.0]
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate(x)], "entity int, d int, r double")
    got = S.effective_sample_size(df, ["entity"], "d", "r").first()
    z = np.array(x) - np.mean(x)
    total = 0.0
    for k in (1, 2, 3):
        rho = z[:-k] @ z[k:] / (z @ z)
        if rho <= 0:
            break
        total += (1 - k / 10) * rho
    assert total > 0 and got.sequence_n == pytest.approx(max(1, min(10, 10 / (1 + 2 * total))))


def test_psi_by_reference_deciles(spark):
    ref, cur = [float(k) for k in range(100)], [float(k % 50) for k in range(100)]
    frame = lambda v: spark.createDataFrame([(x,) for x in v], "r double")
    edges = np.quantile(ref, np.linspace(0, 1, 11))
    p, q = (np.clip(np.histogram(v, edges)[0] / 100, 1e-6, None) for v in (ref, cur))
    got = S.psi(frame(ref), frame(cur), "r").first()
    assert got.psi == pytest.approx(float(((q - p) * np.log(q / p)).sum())) and got.status == "significant_drift"
    assert S.psi(frame(ref[:5]), frame(cur), "r").first().status == "insufficient_sample" and S.psi(frame([1.0] * 20), frame(cur), "r").first().status == "stable"


def test_risk_and_allocations_by_formula(spark):
    r = [0.10, -0.05, 0.02, -0.01]
    got = Po.risk(spark.createDataFrame([(1, day(k), v) for k, v in enumerate(r)], "entity int, d date, r double")).first()
    assert got.downside == pytest.approx(math.sqrt((0.05**2 + 0.01**2) / 4) * math.sqrt(252)) and got.max_drawdown == pytest.approx(0.95 * 1.02 * 0.99 - 1 if 0.95 * 1.02 * 0.99 < 0.95 else -0.05)
    cov = np.array([[0.04, 0.01, 0.0], [0.01, 0.09, 0.02], [0.0, 0.02, 0.16]])
    w = Po.hierarchical_parity(cov)
    right = cov[1:, 1:].mean()
    a = right / (0.04 + right)
    b = 0.16 / 0.25
    assert w == pytest.approx([a, (1 - a) * b, (1 - a) * (1 - b)])
    x = Po.risk_parity(cov)
    assert x * (cov @ x) / (x @ cov @ x) == pytest.approx(np.full(3, 1 / 3), abs=1e-3)
    s = Po.shrunk_to_diagonal(cov, 6)
    assert s[0, 1] == pytest.approx(0.005) and s[0, 0] == 0.04


def test_continuous_rules(spark):
    rows = [(day(0), "A", day(20), 10.0, 5.0, 9.0), (day(0), "B", day(90), 11.0, 6.0, 8.0), (day(18), "A", day(20), 10.0, 5.0, 9.0), (day(18), "B", day(90), 12.0, 4.0, 8.0), (day(30), "B", day(90), 13.0, 1.0, 1.0)]
    c = spark.createDataFrame(rows, "d date, contract string, expiry date, close double, volume double, open_interest double")
    pick = {rule: [r.contract for r in Fi.continuous(c, 5, rule).orderBy("d").collect()] for rule in Fi.ROLL_RULES}
    assert pick == {"expiry": ["A", "B", "B"], "volume": ["B", "A", "B"], "open_interest": ["A", "A", "B"], "combined": ["A", "B", "B"]}
    pairs = spark.createDataFrame([("A", "B")], "old string, new string")
    at = {rule: Fi.crossovers(c, pairs, rule).first() for rule in ("liquidity", "open_interest", "expiry")}
    assert at["liquidity"].d == day(0) and at["open_interest"].d == day(18) and at["expiry"].d == day(18) and at["expiry"].difference == 2.0
    with pytest.raises(ValueError):
        Fi.continuous(c, 5, "other")


def test_membership_is_judged_by_the_past(spark):
    p = spark.createDataFrame([(1, "X", day(k), 1.0, v) for k, v in enumerate([5.0, 100.0, 1.0])] + [(1, "Y", day(2), 1.0, 9.0)], "entity int, board string, d date, close double, value double")
    life = spark.createDataFrame([(1, "X", day(0), None, False), (1, "Y", day(0), day(1), True)], "entity int, board string, valid_from date, valid_to date, is_primary boolean")
    got = P.membership(p, life, 50.0).orderBy("d").collect()
    assert [(r.board, r.liquidity, r.eligible) for r in got] == [("X", None, False), ("X", 5.0, False), ("Y", None, False)]


def test_spaced_choice_of_a_long_series(spark):
    r = np.random.default_rng(1)
    x = r.permutation(3000).tolist()
    df = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(x)], "entity int, pos int, distance double")
    got = [q.pos for q in A.spaced_top_k(df, ["entity"], "distance", "pos", 20, 5).orderBy("rank").collect()]
    want = []
    for pos in sorted(range(3000), key=lambda k: x[k]):
        if len(want) < 5 and all(abs(pos - w) >= 20 for w in want):
            want.append(pos)
    assert got == want


def test_warping_equals_recursion(spark):
    r = np.random.default_rng(2)

    def slow(a, b, i, j):
        if i < 0 or j < 0:
            return 0.0 if i == j == -1 else math.inf
        return abs(a[i] - b[j]) + min(slow(a, b, i - 1, j), slow(a, b, i, j - 1), slow(a, b, i - 1, j - 1))

    rows = [(r.normal(size=n).tolist(), r.normal(size=m).tolist()) for n, m in ((4, 4), (3, 5), (1, 2), (4, 4))] + [(None, [1.0]), ([], [1.0])]
    got = [x.dtw for x in M.dtw_distance(spark.createDataFrame(rows, "a array<double>, b array<double>").coalesce(1), "a", "b").collect()]
    assert got[:4] == pytest.approx([slow(a, b, len(a) - 1, len(b) - 1) for a, b in rows[:4]]) and got[4:] == [None, None]


def test_nearest_equals_brute_force(spark):
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(400, 6)), 1)
    x[50:60] = x[50]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, [1.0])], "id long, v array<double>")
    got = {}
    for q in M.nearest(df, "id", "v", F.col("id") % 50 == 0, 4, queries_at_once=3, rows_at_once=90).collect():
        got.setdefault(q.query_id, []).append((q["rank"], q.id))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 400, 50):
        c = np.round(u @ u[q], 9)
        order = sorted((k for k in range(400) if k != q), key=lambda k: (-c[k], k))[:4]
        assert [k for _, k in sorted(got[q])] == order


def test_event_rules(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [(1, None, t(1), t(0), t(1), True, True, "a", "validated", "u"), (2, t(0), t(1), None, None, False, False, "a", "validated", ""), (3, t(2), t(1), t(2), t(1), True, False, None, "manual_review", "u")]
    df = spark.createDataFrame(rows, "event_id int, available_from timestamp, announcement_time timestamp, effective_time timestamp, event_start timestamp, scheduled boolean, surprise boolean, content_hash string, status string, source_url string")
    got = {(r.event_id, r.issue) for r in Q.event_issues(df).collect()}
    assert got == {(1, "missing_available_from"), (1, "schedule_conflict"), (1, "effective_before_announcement"), (2, "publication_leakage"), (2, "missing_event_time"), (2, "duplicate_source_copy"), (2, "missing_source"), (3, "manual_review")}


def test_trajectories_and_abstention(spark):
    df = spark.createDataFrame([(0.02, -0.01), (0.04, 0.01), (0.02, 0.05)], "early double, final double")
    assert [r[0] for r in df.select(C.trajectory(F.col("early"), F.col("final"))).collect()] == ["reversed", "faded", "continued"]
    lit = lambda *v: spark.range(1).select(C.abstention(*[F.lit(x) for x in v], 0.1)).first()[0]
    assert lit(9, False, 0.05, False) is None and lit(4, True, 0.1, True) == "weak_analog_sample,regime_novel,strong_model_disagreement,stale_data"


def test_a_broken_swap_is_settled(spark, tmp_path):
    target = f"file://{tmp_path}/t"
    spark.range(3).write.parquet(target + "__old")
    spark.range(5).write.parquet(target + "__staged")
    assert sinks.exists(spark, target) and spark.read.parquet(target).count() == 5
    other = f"file://{tmp_path}/o"
    spark.range(3).write.parquet(other + "__old")
    assert sinks.exists(spark, other) and spark.read.parquet(other).count() == 3 and not sinks.exists(spark, f"file://{tmp_path}/none")


def test_calendar_sized_tables_are_broadcast_only_when_small(spark):
    from chronoframe.operators.joins import small

    plan = lambda most: spark.range(100).join(small(spark.range(50), most), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(50) and "strategy=broadcast" not in plan(49)
    assert W.sessions(spark.createDataFrame([(day(1),), (day(0),), (day(1),)], "d date"), "d").count() == 2


def test_split_plans():
    from chronoframe.operators import splits as Sp

    got = Sp.purged(1000, 20)
    size = (1000 - 250 - 40) // 4
    assert got[:2] == [(0, "train", 0, 250), (0, "test", 270, 270 + size)] and got[-1] == (3, "test", 270 + 3 * size, 270 + 4 * size)
    assert Sp.purged(350, 20) == [] and all(b <= 1000 for *_, b in got)
    assert Sp.expanding(100) == [(0, "train", 0, 40), (0, "test", 40, 55), (1, "train", 0, 55), (1, "test", 55, 70), (2, "train", 0, 70), (2, "test", 70, 85), (3, "train", 0, 85), (3, "test", 85, 100)]
    assert Sp.embargoed(100, 5)[:2] == [(0, "train", 0, 35), (0, "test", 45, 55)]
    assert Sp.holdout(100, 5) == [(0, "train", 0, 55), (0, "validation", 60, 75), (0, "holdout", 80, 100)] and Sp.holdout(200, 0, (0.7, 0.15))[2] == (0, "holdout", 170, 200)
    nested = Sp.nested(2000, 20)
    assert {r for _, r, _, _ in nested} == {"test", "inner_train", "inner_test"}
    for fold, role, a, b in nested:
        if role == "inner_test":
            test = next(x for f, r, x, _ in nested if r == "test" and f // 100 == fold // 100)
            assert b <= test - 20


def test_block_positions():
    random = np.random.default_rng(0)
    for kind in M.BOOTSTRAPS:
        at = M.block_positions(50, 7, 400, kind, random)
        assert at.shape == (400, 50) and at.min() >= 0 and at.max() < 50
        runs = np.diff(at, axis=1) % 50 == 1
        if kind == "stationary":
            assert 1 / 7 == pytest.approx(1 - runs.mean(), abs=0.02)
        else:
            assert all(runs[:, k].all() for k in range(49) if (k + 1) % 7)
        if kind == "moving":
            assert (at[:, ::7] <= 43).all()


def test_bootstraps_cover_the_mean(spark):
    r = np.random.default_rng(5)
    rows = [(1, day(k), float(v)) for k, v in enumerate(r.normal(0.5, 1.0, 400))]
    df = spark.createDataFrame(rows, "entity int, d date, r double")
    values = np.array([x[2] for x in rows])
    spread = values.std() / 20
    for kind in M.BOOTSTRAPS:
        got = M.block_bootstrap(df, "entity", "d", "r", 5, kind=kind).first()
        assert got.mean == pytest.approx(values.mean()) and got.low < got.mean < got.high and 2 * spread < got.high - got.low < 6 * spread
    got = M.clustered_bootstrap(df, "d", "r").first()
    assert (got.n, got.clusters) == (400, 400) and got.mean == pytest.approx(values.mean()) and 2.5 * spread < got.high - got.low < 5.5 * spread
    with pytest.raises(ValueError):
        M.block_bootstrap(df, "entity", "d", "r", 5, kind="other")


def test_platt_equals_newton(spark):
    r = np.random.default_rng(6)
    p = r.uniform(0.02, 0.98, 500)
    y = (r.random(500) < 1 / (1 + np.exp(-(0.5 * np.log(p / (1 - p)) + 0.3)))).astype(int)
    df = spark.createDataFrame([(k, float(a), int(b)) for k, (a, b) in enumerate(zip(p, y))], "k int, p double, y int")
    got = M.platt(df, "p", "y", F.col("k") < 400).orderBy("k").collect()
    x, t, w = np.log(p / (1 - p))[:400], y[:400], np.zeros(2)
    for _ in range(50):
        z = np.column_stack([x, np.ones(400)])
        q = 1 / (1 + np.exp(-z @ w))
        grad = z.T @ (q - t) + np.array([w[0], 0])
        w -= np.linalg.solve(z.T @ (z * (q * (1 - q))[:, None]) + np.diag([1, 0]), grad)
    assert got[0].slope == pytest.approx(w[0], abs=1e-4) and got[0].intercept == pytest.approx(w[1], abs=1e-4)
    assert got[450].calibrated == pytest.approx(1 / (1 + math.exp(-(w[0] * math.log(p[450] / (1 - p[450])) + w[1]))), abs=1e-4)


def test_regime_candidates_find_the_groups(spark):
    r = np.random.default_rng(7)
    centres = np.repeat([[0, 0], [8, 8], [0, 8]], 40, axis=0)[np.tile(np.arange(120).reshape(3, 40).T.ravel(), 2)]
    x = np.repeat(centres, 1, axis=0) + 0.3 * r.normal(size=(240, 2))
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(x)], "pos int, a double, b double")
    got = M.regime_candidates(df, ["a", "b"], "pos", ("kmeans",), (2, 3)).collect()
    best = max(got, key=lambda g: g.score)
    assert best.k == 3 and best.silhouette_test > 0.9
    for g in got:
        assert g.score == pytest.approx(0.35 * g.silhouette_test + 0.25 * g.persistence + 0.25 * g.reproducibility + 0.15 * min(1, g.smallest_share * g.k))


def test_path_statistics_of_two_paths(spark):
    df = spark.createDataFrame([(1, [0.0, -0.11, 0.05, -0.02]), (1, [0.0, 0.20, 0.10, 0.15])], "entity int, v array<double>")
    a, b = A.path_statistics(df, "v").orderBy("mae").collect()
    assert (a.mae, a.mfe, a.time_to_trough, a.time_to_peak, a.recovery_time) == (-0.11, 0.05, 1, 2, 2) and a.max_drawdown == pytest.approx(-0.11)
    assert a.underwater and a.recovered and not a.new_high_after_recovery and not a.fall_first_end_positive
    assert (b.time_to_trough, b.recovery_time, b.recovered, b.new_high_after_recovery, b.underwater) == (0, 1, False, True, False) and b.max_drawdown == pytest.approx(1.10 / 1.20 - 1)
    got = A.path_risk(A.path_statistics(df, "v").withColumn("weight", F.when(F.col("mae") < 0, 3.0).otherwise(1.0)), ["entity"], "weight").first()
    assert (got.n, got.underwater, got.recovered, got.drawdown_5, got.drawdown_10) == (2, 0.75, 0.75, 1.0, pytest.approx(0.75)) and got.effective_n == pytest.approx(16 / 10) and got.median_drawdown == pytest.approx(-0.11)


def test_distances_under_a_fitted_covariance(spark):
    r = np.random.default_rng(9)
    x = r.normal(size=(80, 4)) @ r.normal(size=(4, 4)) + 3
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>").repartition(3)
    z = x - x.mean(0)
    s = z.T @ z / 80
    mu = np.trace(s) / 4
    spread = ((s - mu * np.eye(4)) ** 2).sum()
    noise = min(sum(((np.outer(q, q) - s) ** 2).sum() for q in z) / 80**2, spread)
    pulled = noise / spread * mu * np.eye(4) + (1 - noise / spread) * s
    got = {q.id: q for q in M.covariance_distances(df, "id", "v", 2, state=x[5].tolist()).collect()}
    for k in (0, 5, 79):
        d = x[k] - x[5]
        assert got[k].mahalanobis == pytest.approx(math.sqrt(max(d @ np.linalg.solve(pulled, d), 0)), abs=1e-9)
    flat = spark.createDataFrame([(k, [float(k), float(k), 0.0]) for k in range(9)], "id long, v array<double>")
    assert all(q.mahalanobis is None for q in M.covariance_distances(flat, "id", "v", 1, intensity=0.0).collect())
