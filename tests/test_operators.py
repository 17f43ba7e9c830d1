"""Operators on hand-computed cases, and point-in-time invariance under changes of the future."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoframe.operators import analogs as A
from chronoframe.operators import events as E
from chronoframe.operators import finance as Fi
from chronoframe.operators import joins as J
from chronoframe.operators import models as M
from chronoframe.operators import panel as P
from chronoframe.operators import portfolio as Po
from chronoframe.operators import quality as Q
from chronoframe.operators import stats as S
from chronoframe.operators import windows as W

D0 = dt.date(2024, 1, 1)


def day(n):
    return D0 + dt.timedelta(n)


def prices(spark, closes, entity=1, volume=1000.0):
    rows = [(entity, day(k), c, None if c is None else c * volume, volume) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, "entity int, d date, close double, value double, volume double")


def test_total_returns_with_a_dividend(spark):
    paid = spark.createDataFrame([(1, day(1), 5.0), (1, day(99), 7.0)], "entity int, d date, dividend double")
    r = P.total_returns(prices(spark, [100.0, 110.0, 110.0]), paid).orderBy("d").collect()
    assert r[0].price_return is None and r[0].total_return_index == 1.0
    assert math.isclose(r[1].price_return, 0.10) and math.isclose(r[1].dividend_return, 0.05) and math.isclose(r[1].total_return_index, 1.15)
    assert math.isclose(r[2].total_return, 0.0, abs_tol=1e-12) and math.isclose(r[2].total_return_index, 1.15)


def test_missing_close_uses_the_last_known_one(spark):
    none = spark.createDataFrame([], "entity int, d date, dividend double")
    r = P.total_returns(prices(spark, [100.0, None, 120.0, 0.0, 5.0]), none).orderBy("d").collect()
    assert r[1].price_return is None and math.isclose(r[2].price_return, 0.2) and r[4].price_return is None


def test_forward_frame_leaves_the_tail_null(spark):
    r = P.forward(prices(spark, [100.0, 90.0, 120.0, 110.0]), (2,)).orderBy("d").collect()
    assert math.isclose(r[0].forward_return_2, 0.2) and math.isclose(r[0].forward_drawdown_2, -0.1) and math.isclose(r[0].forward_gain_2, 0.2)
    assert r[2].forward_return_2 is None and r[3].forward_drawdown_2 is None


def test_canonical_takes_priority_then_board(spark):
    p = spark.createDataFrame([(1, "OLD", day(2), 1.0), (1, "NEW", day(2), 2.0), (1, "OLD", day(1), 3.0)], "entity int, board string, d date, close double")
    s = spark.createDataFrame([(1, "OLD", day(0), day(2), 90), (1, "NEW", day(2), None, 100)], "entity int, board string, valid_from date, valid_to date, priority int")
    assert [(r.d, r.board) for r in P.canonical(p, s).orderBy("d").collect()] == [(day(1), "OLD"), (day(2), "NEW")]


def test_features_do_not_see_the_future(spark):
    base = [100 + k % 7 + 0.1 * k for k in range(60)]
    later = [c if k < 40 else c * 10 for k, c in enumerate(base)]
    for f in (P.liquidity, lambda p: P.returns(p), lambda p: p.withColumn("z", P.zscore_before("close", W.by_time("entity", "d"), 20))):
        a = f(prices(spark, base)).where(F.col("d") < day(40)).orderBy("d").collect()
        b = f(prices(spark, later)).where(F.col("d") < day(40)).orderBy("d").collect()
        assert a == b


def test_membership_uses_yesterdays_liquidity(spark):
    w = W.by_time("entity", "d").rowsBetween(-1, -1)
    p = spark.createDataFrame([(1, day(k), v) for k, v in enumerate((1.0, 1000.0, 1000.0))], "entity int, d date, value double")
    got = [r.x for r in p.select("d", (F.percentile("value", F.lit(0.5)).over(w) >= 500).alias("x")).orderBy("d").collect()]
    assert got == [None, False, True]


def test_rolling_min_periods_and_gaps(spark):
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate((1.0, None, 3.0, 5.0))], "e int, t int, x double")
    w = W.frame(W.by_time("e", "t"), 3)
    got = [r.m for r in df.select("t", W.rolling(F.avg("x"), F.col("x"), w, 2).alias("m")).orderBy("t").collect()]
    assert got == [None, None, 2.0, 4.0]


def test_average_rank_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (1, 1.0), (1, None)], "g int, x double")
    got = sorted((r.x is None, r.x or 0, r.p) for r in df.select("x", W.percentile_rank("x", ["g"]).alias("p")).collect())
    assert [g[2] for g in got] == [1 / 3, 2.5 / 3, 2.5 / 3, None]


def test_runs_and_episodes(spark):
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate((1, 1, None, None, 1))], "e int, t int, s int")
    got = [(r.run, r.duration) for r in W.run_length(W.run_id(df, ["e"], "t", "s"), ["e"], "t", "s").orderBy("t").collect()]
    assert got == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1)]
    w = W.by_time("e", "t")
    e = W.episodes(spark.createDataFrame([(1, 0), (1, 3), (1, 20)], "e int, t int"), ["e"], "t", F.col("t") - F.lag("t").over(w) > 5)
    assert [r.episode for r in e.orderBy("t").collect()] == [1, 1, 2]


def test_drawdown_of_an_array(spark):
    assert math.isclose(spark.sql("SELECT array(1D, 2D, 1D, 3D, 2D) AS a").select(W.drawdown_of(F.col("a")).alias("x")).first().x, -0.5)


def test_asof_matches_exactly_backward_and_forward(spark):
    left = spark.createDataFrame([("a", day(k)) for k in range(4)], "s string, t date")
    right = spark.createDataFrame([("a", day(1), 10), ("a", day(3), 30), ("a", day(3), 31), ("b", day(0), 5)], "s string, at date, v int")
    back = J.asof(left, right, ["s"], "t", "at", ["v"]).orderBy("t").collect()
    assert [(r.v, r.asof_at) for r in back] == [(None, None), (10, day(1)), (10, day(1)), (31, day(3))]
    assert J.asof(left, right, ["s"], "t", "at", ["v"], inner=True).count() == 3
    ahead = J.asof(left, right, ["s"], "t", "at", ["v"], forward=True).orderBy("t").collect()
    assert [r.asof_at for r in ahead] == [day(1), day(1), day(3), day(3)]


@pytest.mark.parametrize("forward", [False, True])
def test_asof_in_buckets_is_the_same(spark, forward):
    left = spark.createDataFrame([("a" if k % 3 else None, day(k * 7), k) for k in range(60)], "s string, t date, n int")
    right = spark.createDataFrame([("a" if k % 2 else "b", day(k * 23 % 400), k) for k in range(20)] + [(None, day(50), 99)], "s string, at date, v int")
    one = J.asof(left, right, ["s"], "t", "at", ["v"], forward=forward)
    for unit in ("day", "month", "year"):
        cut = J.asof(left, right, ["s"], "t", "at", ["v"], forward=forward, bucket=unit)
        assert sorted(map(str, cut.collect())) == sorted(map(str, one.collect()))


def test_spaced_top_k(spark):
    df = spark.createDataFrame([(1, 0.1, 10), (1, 0.2, 15), (1, 0.3, 40), (1, 0.3, 35), (1, 0.4, 90)], "e int, x double, pos int")
    assert [(r["rank"], r.pos) for r in A.spaced_top_k(df, ["e"], "x", "pos", 20, 3).orderBy("rank").collect()] == [(1, 10), (2, 35), (3, 90)]


@pytest.mark.parametrize("path,side,session", [([0.0, 0.02, 0.06, -0.10], "upper", 3), ([0.0, -0.02, -0.06, 0.10], "lower", 3), ([0.0, 0.01, -0.01], "neither", None)])
def test_first_passage(spark, path, side, session):
    r = spark.createDataFrame([(path,)], "p array<double>").select(A.first_passage(F.col("p"), 0.05, -0.05).alias("x")).first().x
    assert (r.side, r.session) == (side, session)


def test_weighted_quantile_does_not_interpolate(spark):
    df = spark.createDataFrame([("a", x, w) for x, w in ((1.0, 0.2), (2.0, 0.3), (3.0, 0.5))], "k string, x double, w double")
    r = A.weighted_quantile(df, ["k"], "x", "w", (0.1, 0.5, 0.51)).first()
    assert (r.q10, r.q50, r.q51) == (1.0, 2.0, 3.0)
    assert math.isclose(df.agg(A.effective_sample("w").alias("n")).first().n, 1 / (0.04 + 0.09 + 0.25))


def test_family_distance_moves_missing_weight(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, 3.0)], "a double, b double")
    x = A.family_distance({"a": F.col("a"), "b": F.col("b")}, {"a": 0.5, "b": 0.5})
    assert [r.x for r in df.select(x.alias("x")).collect()] == [1.0, 2.0]


def test_dtw():
    assert M.warping(np.array([[1, 2, 3]]), np.array([[1, 2, 2, 3]])) == 0 and M.warping(np.array([[0, 0]]), np.array([[1, 1]])) == 2


def test_exclusive_quantile(spark):
    import statistics

    v = [1.0, 2.0, 4.0, 8.0, 16.0]
    df = spark.createDataFrame([(v, len(v))], "v array<double>, n int")
    got = df.select(S.exclusive_quantile("v", "n", 0.25).alias("a"), S.exclusive_quantile("v", "n", 0.75).alias("b")).first()
    q = statistics.quantiles(v, n=4)
    assert (got.a, got.b) == (q[0], q[2])


def test_bh_qvalues(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.9)], "k string, p double")
    got = {r.k: round(r.q, 9) for r in S.bh_qvalues(df, "p", ["k"]).collect()}
    assert got == {"a": 0.04, "c": round(0.16 / 3, 9), "b": round(0.16 / 3, 9), "d": 0.9}


def test_auc_with_ties_and_one_class(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.1), ("a", 1, 0.5), ("a", 0, 0.5), ("b", 1, 0.5)], "k string, y int, s double")
    assert {r.k: r.auc for r in S.auc(df, ["k"], "y", "s").collect()} == {"a": 0.875, "b": None}


def test_wilson_interval(spark):
    low, high = S.wilson(F.lit(8), F.lit(10))
    r = spark.range(1).select(low.alias("a"), high.alias("b")).first()
    assert (round(r.a, 4), round(r.b, 4)) == (0.4902, 0.9433)


def test_transitions_add_one(spark):
    df = spark.createDataFrame([(1, k, s) for k, s in enumerate((0, 0, 1))], "e int, t int, s int")
    got = {(r.from_state, r.to_state): (r.n, r.probability) for r in S.transitions(df, ["e"], "t", "s", [0, 1]).collect()}
    assert got == {(0, 0): (1, 0.5), (0, 1): (1, 0.5), (1, 0): (0, 0.5), (1, 1): (0, 0.5)}


def test_row_rules_and_future_guard(spark):
    p = spark.createDataFrame([(1, D0, 5.0, 4.0, 3.0, 9.0, 1.0, -1.0)], "entity int, d date, open double, high double, low double, close double, value double, volume double")
    assert {r.issue_type for r in Q.row_rules(p).collect()} == {"negative_volume", "open_outside_range", "close_outside_range"}
    df = spark.createDataFrame([(day(2), day(1))], "s date, t date")
    with pytest.raises(Exception, match="future data"):
        Q.require_no_future(df, "s", "t").collect()
    with pytest.raises(Exception, match="duplicate key"):
        Q.require_unique(spark.createDataFrame([(1,), (1,)], "k int"), ["k"]).collect()


def test_futures_chain_and_adjustment(spark):
    rows = [(day(k), c, day(e), float(p), 1.0) for k in range(4) for c, e, p in (("A", 2, 100 + k), ("B", 30, 110 + k))]
    c = spark.createDataFrame(rows, "d date, contract string, expiry date, close double, volume double")
    chain = Fi.continuous(c, 1)
    assert [r.contract for r in chain.orderBy("d").collect()] == ["A", "B", "B", "B"]
    rolls = Fi.rolls(chain, c).collect()
    assert len(rolls) == 1 and rolls[0].difference == 10.0
    first = Fi.adjusted(chain, Fi.rolls(chain, c)).orderBy("d").first()
    assert first.back_adjusted == 110.0 and math.isclose(first.ratio_adjusted, 100 * 111 / 101)


def test_implied_volatility_round_trip(spark):
    rows = [(float(Fi._erf_price(100.0, k, 1.0, 0.05, 0.3, c)), 100.0, k, 1.0, 0.05, bool(c)) for k in (90.0, 100.0, 115.0) for c in (True, False)]
    df = spark.createDataFrame([*rows, (0.0, 100.0, 90.0, 1.0, 0.05, True)], "price double, spot double, strike double, years double, rate double, call boolean")
    got = [r.implied for r in Fi.implied_volatility(df).collect()]
    assert all(abs(x - 0.3) < 1e-6 for x in got[:-1]) and got[-1] is None


def test_curve_interpolation_is_flat_outside(spark):
    c = spark.createDataFrame([(D0, 1.0, 5.0), (D0, 3.0, 7.0)], "d date, tenor double, yield double")
    got = {r.tenor: r["yield"] for r in Fi.interpolate(c, (0.5, 1, 2, 9)).collect()}
    assert got == {0.5: 5.0, 1.0: 5.0, 2.0: 6.0, 9.0: 7.0}


def test_valuation_bounds(spark):
    one = spark.range(1)
    assert one.select(Fi.gordon(F.lit(10.0), 0.1, 0.1).alias("x")).first().x is None
    assert math.isclose(one.select(Fi.justified_pb(F.lit(0.2), 0.04, 0.12).alias("x")).first().x, 2.0)


def test_event_states_and_surprises_have_no_countdown(spark):
    cal = spark.createDataFrame([(day(k),) for k in range(40)], "d date")
    ev = spark.createDataFrame([(1, day(10), False), (2, day(10), True)], "event_id int, event_d date, surprise boolean")
    got = {(r.event_id, (r.d - day(10)).days): r.state for r in E.timeline(cal, ev, F.col("surprise")).collect()}
    assert got[(1, -5)] == "pre_event" and (2, -1) not in got and got[(2, 0)] == "event_day" and got[(1, 1)] == "post_1" and got[(1, 5)] == "post_5" and got[(1, 20)] == "post_20" and (1, 21) not in got


def test_maturity_is_pending_without_enough_sessions(spark):
    cal = spark.createDataFrame([(day(k * 2),) for k in range(5)], "d date")
    f = spark.createDataFrame([(day(0), 2), (day(6), 2)], "cutoff date, horizon int")
    assert [r.matures for r in E.maturity(f, cal).orderBy("cutoff").collect()] == [day(4), None]


def test_portfolio_weights():
    import numpy as np

    cov = np.diag([0.04, 0.01])
    assert np.allclose(Po.minimum_variance(cov), [0.2, 0.8]) and np.allclose(Po.risk_parity(cov), [1 / 3, 2 / 3], atol=1e-6)
    assert np.allclose(Po.hierarchical_parity(cov), [0.2, 0.8]) and np.allclose(Po.capped(np.array([0.9, 0.05, 0.05]), 0.5), [0.5, 0.25, 0.25])


def test_nearest_and_models(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (3, None), (4, [1.0, 0.0, 0.0])], "id long, v array<double>")
    got = [(r.query_id, r.id) for r in M.nearest(v, "id", "v", F.col("id") == 0, 1).collect()]
    assert got == [(0, 1)]
    rows = [(1, k, math.sin(k / 3), 2 * math.sin(k / 3) + 1) for k in range(200)]
    out = M.walk_forward_ridge(spark.createDataFrame(rows, "e int, t int, x double, y double"), "e", "t", ["x"], "y", 5, alpha=1e-6)
    assert out.agg(F.max(F.abs(F.col("y") - F.col("prediction"))).alias("m")).first().m < 1e-3 and out.agg(F.min("t")).first()[0] == 80
    hm = spark.createDataFrame([(1, k, (5.0 if k % 40 < 20 else -5.0) + 0.1 * (k % 3)) for k in range(200)], "e int, t int, r double")
    assert M.viterbi_by_entity(hm, "e", "t", "r", 2).where("(state = 1) <> (r > 0)").count() == 0


def test_quantile_code_equals_ntile(spark):
    df = spark.createDataFrame([(k % 4 * 1.0, k) for k in range(23)], "x double, t int")
    w = Window.orderBy("x", "t")
    assert S.quantile_code(df, "x", ["t"], 5, "c").withColumn("n", F.ntile(5).over(w)).where("c <> n").count() == 0


@pytest.mark.parametrize("path,shape", [([0.05, -0.06, 0.05], "high_volatility"), ([-0.02, -0.05, -0.03, 0.0, 0.02], "dip_then_recover"), ([0.03, 0.05, 0.02, 0.0], "rise_then_fall"), ([0.01, 0.02, 0.03], "steady_up"), ([-0.01, -0.02, -0.03], "steady_down"), ([0.01, -0.01, 0.0], "sideways")])
def test_path_shape_rules(spark, path, shape):
    from chronoframe.operators import rules as R

    df = P.path_facts(spark.createDataFrame([(path,)], "p array<double>"), "p")
    assert df.select(R.label(R.PATH_SHAPE, "sideways").alias("x")).first().x == shape


def test_fixed_rules(spark):
    from chronoframe.operators import rules as R

    one = spark.range(1)
    lit = F.lit
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(R.integrity(lit(False), lit(False), lit(True), lit(2), lit(1), lit(0.1), lit(True))) == 100 - 25 - 30 - 6 - 5 - 2
    assert get(R.confounding(lit(2), lit(-0.04), lit(False))) == "heavily_confounded" and get(R.confounding(lit(1), lit(0.0), lit(False))) == "clean_event"
    score, status = R.source_priority(*[lit(k) for k in (3, 3, 3, 3, 3, 2, 0, 0)])
    assert (get(score), get(status)) == (35, "paid_optional")
    assert get(R.bounded(lit(None).cast("double"), 0.1)) == 0.0 and get(R.bounded(lit(-0.15), -0.3)) == 0.5
    clock = spark.createDataFrame([("09:59",), ("10:05",), ("18:45",), ("19:00",)], "clock string")
    assert [r.x for r in clock.select(R.label(R.SESSION_5, "evening").alias("x")).collect()] == ["morning", "opening_auction", "closing_auction", "evening"]
    text = spark.createDataFrame([("Key rate and dividend",), ("Profit growth, risk",), ("x",)], "t string")
    assert [(r.c, r.k) for r in text.select(E.event_class("t").alias("c"), E.tone("t").alias("k")).collect()] == [("rates", "uncertain"), ("earnings", "mixed"), ("other", "uncertain")]
