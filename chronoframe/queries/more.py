"""Trend runs, further rules, representatives, comparisons, pooled and per-entity models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions.expr import corr, ratio, round6
from chronoframe.operators import analogs as A
from chronoframe.operators import models as M
from chronoframe.operators import quality as Q
from chronoframe.operators import rules as R
from chronoframe.operators import stats as S
from chronoframe.operators import windows as W
from chronoframe.operators.panel import returns, total_returns
from chronoframe.plans.bindings import Tables
from chronoframe.queries.aggregates import PRED, predictions
from chronoframe.queries.registry import query
from chronoframe.queries.similarity import FEATURES, STATE, state


@query("""WITH a AS (SELECT entity, d, CASE WHEN count(close) OVER w >= 200 THEN close >= avg(close) OVER w END AS above FROM panel WINDOW w AS (PARTITION BY entity ORDER BY d ROWS 199 PRECEDING)),
c AS (SELECT *, coalesce(above, false) AS up, CASE WHEN coalesce(above, false) IS DISTINCT FROM lag(coalesce(above, false)) OVER (PARTITION BY entity ORDER BY d) THEN 1 ELSE 0 END AS ch FROM a),
r AS (SELECT *, sum(ch) OVER (PARTITION BY entity ORDER BY d) AS run FROM c) SELECT entity, d, CASE WHEN up THEN row_number() OVER (PARTITION BY entity, run ORDER BY d) ELSE -1 END AS days_vs_sma_200 FROM r""")
def trend_run_length(t: Tables) -> DataFrame:
    """Rows since the close came to its 200-row mean or above; -1 below it and while the mean is forming."""
    w = W.frame(W.by_time("entity", "d"), 200)
    mean = W.rolling(F.avg("close"), F.col("close"), w, 200)
    a = t.panel().select("entity", "d", F.coalesce(F.col("close") >= mean, F.lit(False)).alias("up"))
    return W.run_length(a, ["entity"], "d", "up").select("entity", "d", F.when(F.col("up"), F.col("duration")).otherwise(-1).cast("long").alias("days_vs_sma_200"))


@query("""WITH v AS (SELECT *, volume / nullif(avg(volume) OVER w, 0) AS rv, (close - avg(close) OVER w) / nullif(stddev_samp(close) OVER w, 0) AS z, (close - min(low) OVER w) / nullif(max(high) OVER w - min(low) OVER w, 0) AS pos,
  avg(high - low) OVER w / nullif(close, 0) AS rng, corr(close, volume) OVER w AS cv, count(*) OVER w AS n FROM panel WINDOW w AS (PARTITION BY entity ORDER BY d ROWS 19 PRECEDING))
SELECT entity, d, CASE WHEN n >= 20 THEN round(rv, 6) END AS relative_volume, CASE WHEN n >= 20 THEN round(z, 5) END AS price_z, CASE WHEN n >= 20 THEN round(pos, 6) END AS range_position, CASE WHEN n >= 20 THEN round(rng, 6) END AS mean_range, CASE WHEN n >= 20 THEN round(cv, 5) END AS price_volume_corr FROM v""")
def features_volume_range(t: Tables) -> DataFrame:
    w = W.frame(W.by_time("entity", "d"), 20)
    low, high = F.min("low").over(w), F.max("high").over(w)
    v = t.panel().select("entity", "d", F.count(F.lit(1)).over(w).alias("n"), ratio("volume", F.avg("volume").over(w)).alias("rv"), ratio(F.col("close") - F.avg("close").over(w), F.stddev_samp("close").over(w)).alias("z"),
                         ratio(F.col("close") - low, high - low).alias("pos"), ratio(F.avg(F.col("high") - F.col("low")).over(w), "close").alias("rng"), corr("close", "volume", over=w).alias("cv"))
    full = lambda c, n: F.when(F.col("n") >= 20, F.round(c, n))
    return v.select("entity", "d", full("rv", 6).alias("relative_volume"), full("z", 5).alias("price_z"), full("pos", 6).alias("range_position"), full("rng", 6).alias("mean_range"), full("cv", 5).alias("price_volume_corr"))


@query("""WITH dv AS (SELECT o_custkey % 120 + 1 AS entity, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderkey % 50 = 0 THEN -1.0 ELSE o_totalprice / 1000 END AS dividend FROM orders WHERE o_orderpriority = '2-HIGH'), sp AS (SELECT entity, min(d) AS a, max(d) AS b FROM panel GROUP BY 1)
SELECT issue_type, count(*) AS n FROM (SELECT 'nonpositive_dividend' AS issue_type FROM dv WHERE dividend <= 0 UNION ALL SELECT 'orphan_dividend' FROM dv WHERE NOT EXISTS (SELECT 1 FROM panel p WHERE p.entity = dv.entity AND p.d = dv.d)
UNION ALL SELECT 'dividend_out_of_history' FROM dv LEFT JOIN sp ON dv.entity = sp.entity WHERE a IS NULL OR NOT (d BETWEEN a AND b)) GROUP BY 1""")
def dividend_rules(t: Tables) -> DataFrame:
    o = t("orders").where("o_orderpriority = '2-HIGH'")
    dv = o.select((F.col("o_custkey") % 120 + 1).alias("entity"), F.to_date("o_orderdate").alias("d"), F.when(F.col("o_orderkey") % 50 == 0, -1.0).otherwise(F.col("o_totalprice") / 1000).alias("dividend"))
    return Q.dividend_rules(dv, t.panel()).groupBy("issue_type").agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT entity, d, CASE WHEN entity % 5 = 0 AND day(d) = 1 THEN 0.0 WHEN entity % 5 = 1 AND day(d) = 2 THEN NULL WHEN entity % 5 = 2 AND day(d) = 3 THEN 'inf'::DOUBLE WHEN entity % 5 = 3 AND day(d) = 4 THEN 'nan'::DOUBLE WHEN entity % 5 = 4 AND day(d) = 5 THEN -close ELSE close END AS i FROM panel)
SELECT 'invalid_index' AS issue_type, entity, d, '' AS detail FROM x WHERE i IS NULL OR NOT isfinite(i) OR i <= 0""")
def index_rules(t: Tables) -> DataFrame:
    """Index levels broken on purpose: zero, unknown, infinite, not a number, negative."""
    day, k = F.dayofmonth("d"), F.col("entity") % 5
    level = F.when((k == 0) & (day == 1), 0.0).when((k == 1) & (day == 2), F.lit(None)).when((k == 2) & (day == 3), float("inf")).when((k == 3) & (day == 4), float("nan")).when((k == 4) & (day == 5), -F.col("close")).otherwise(F.col("close"))
    return Q.index_rules(t.panel().select("entity", "d", level.cast("double").alias("total_return_index")))


@query("""WITH j AS (SELECT p_partkey, p_size % 4 AS a, p_partkey % 4 AS b, (p_size + p_partkey) % 4 AS c FROM part), s AS (SELECT *, a * 3 + b * 2 + c * 3 + a * 3 + b * 2 - c * 2 - a - b * 3 AS score FROM j)
SELECT p_partkey, score, CASE WHEN score >= 20 AND c >= 2 THEN 'paid_optional' WHEN score >= 27 THEN 'critical' WHEN score >= 20 THEN 'high' WHEN score >= 12 THEN 'medium' ELSE 'low' END AS status FROM s""")
def source_priority(t: Tables) -> DataFrame:
    a, b, c = F.col("p_size") % 4, F.col("p_partkey") % 4, (F.col("p_size") + F.col("p_partkey")) % 4
    score, status = R.source_priority(a, b, c, a, b, c, a, b)
    return t("part").select("p_partkey", score.alias("score"), status.alias("status"))


@query(f"""WITH {STATE}, rep AS (SELECT pos AS r FROM state WHERE pos % 60 = 0), x AS (SELECT s.pos, r, row_number() OVER (PARTITION BY s.pos ORDER BY abs(s.pos - r), r) AS n FROM state s, rep) SELECT pos, r AS representative FROM x WHERE n = 1""")
def episode_representatives(t: Tables) -> DataFrame:
    s = state(t).select("pos").withColumn("k", F.lit(1))
    return A.nearest_representative(s, s.where("pos % 60 = 0"), ["k"], "pos").select("pos", "representative")


@query(f"""WITH {STATE}, l AS (SELECT mom > 0 AS a, vol > 0.2 AS b FROM state ORDER BY pos DESC LIMIT 1) SELECT pos, round((CASE WHEN (mom > 0) = a THEN 1 ELSE 0 END + CASE WHEN pos % 4 > 0 AND (vol > 0.2) = b THEN 1 ELSE 0 END) / CAST(1 + CASE WHEN pos % 4 > 0 THEN 1 ELSE 0 END AS DOUBLE), 6) AS compatibility FROM state, l""")
def regime_compatibility(t: Tables) -> DataFrame:
    s = state(t)
    last = s.agg(F.max_by(F.col("mom") > 0, "pos").alias("a"), F.max_by(F.col("vol") > 0.2, "pos").alias("b"))
    here = {"trend": F.col("mom") > 0, "vol": F.when(F.col("pos") % 4 > 0, F.col("vol") > 0.2)}
    return s.join(F.broadcast(last)).select("pos", round6(A.compatibility(here, {"trend": F.col("a"), "vol": F.col("b")})).alias("compatibility"))


@query(f"""WITH {PRED}, e AS (SELECT entity, d, abs(y - p) - abs(y) AS x FROM pred WHERE y IS NOT NULL AND p IS NOT NULL), z AS (SELECT *, x - avg(x) OVER (PARTITION BY entity) AS z, avg(x) OVER (PARTITION BY entity) AS m FROM e), l AS (SELECT *, lag(z, 1) OVER w AS z1, lag(z, 2) OVER w AS z2, lag(z, 3) OVER w AS z3, lag(z, 4) OVER w AS z4 FROM z WINDOW w AS (PARTITION BY entity ORDER BY d)),
g AS (SELECT entity, count(*) AS n, any_value(m) AS m, sum(z * z) / count(*) AS g0, coalesce(sum(z * z1), 0) / count(*) AS g1, coalesce(sum(z * z2), 0) / count(*) AS g2, coalesce(sum(z * z3), 0) / count(*) AS g3, coalesce(sum(z * z4), 0) / count(*) AS g4 FROM l GROUP BY 1)
SELECT entity, n, round(m, 6) AS mean_difference, round(m / nullif(sqrt(greatest(g0 + 1.6 * g1 + 1.2 * g2 + 0.8 * g3 + 0.4 * g4, 0) / n), 0), 4) AS dm FROM g""")
def diebold_mariano(t: Tables) -> DataFrame:
    e = predictions(t).where("y IS NOT NULL AND p IS NOT NULL").select("entity", "d", (F.abs(F.col("y") - F.col("p")) - F.abs("y")).alias("x"))
    g = S.autocovariances(e, ["entity"], "d", "x", 4)
    return g.select("entity", "n", round6("mean").alias("mean_difference"), F.round(S.newey_west(g, 4), 4).alias("dm"))


@query(f"""WITH {PRED}, c AS (SELECT entity, corr(y, p) FILTER (WHERE d < DATE '1999-01-01') AS h, corr(y, p) FILTER (WHERE d >= DATE '1999-01-01') AS r FROM pred WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY 1)
SELECT entity, round(h, 5) AS historical_ic, round(r, 5) AS recent_ic, {R.case(R.DRIFT, 'stable')} AS drift FROM c""")
def concept_drift(t: Tables) -> DataFrame:
    early = F.col("d") < F.lit("1999-01-01").cast("date")
    part = lambda c: corr(F.when(c, F.col("y")), F.when(c, F.col("p")))
    c = predictions(t).where("y IS NOT NULL AND p IS NOT NULL").groupBy("entity").agg(part(early).alias("h"), part(~early).alias("r"))
    return c.select("entity", F.round("h", 5).alias("historical_ic"), F.round("r", 5).alias("recent_ic"), R.label(R.DRIFT, "stable").alias("drift"))


@query("""WITH f AS (SELECT event_id, user_id, ts, value, avg(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS m, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM events)
SELECT event_id, n, round(m, 6) AS mean_1d, round(value - m, 6) AS excess FROM f""")
def time_range_window(t: Tables) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(at).rangeBetween(-86_400_000_000, 0)
    f = t("events").select("event_id", F.count(F.lit(1)).over(w).alias("n"), F.avg("value").over(w).alias("m"), "value")
    return f.select("event_id", "n", round6("m").alias("mean_1d"), round6(F.col("value") - F.col("m")).alias("excess"))


@query(None)
def elastic_net_pooled(t: Tables) -> DataFrame:
    rows = predictions(t).where("y IS NOT NULL")
    out = M.elastic_net(rows, ["p", "s"], "y", F.col("d") < F.lit("1999-01-01").cast("date"))
    return out.groupBy("entity").agg(F.count("*").alias("n"), round6(F.avg(F.abs(F.col("y") - F.col("prediction")))).alias("mae"))


@query(None)
def model_tournament(t: Tables) -> DataFrame:
    out = M.tournament(predictions(t).select("entity", "d", "y", "p", "s"), "entity", "d", ["p", "s"], "y", 5)
    return out.select("entity", "model", "n", round6("validation_mae").alias("validation_mae"), round6("holdout_mae").alias("holdout_mae"), "winner")


@query(None)
def permutation_sanity(t: Tables) -> DataFrame:
    out = M.permutation_sanity(predictions(t).select("entity", "d", "y", "p"), "entity", "d", "p", "y")
    return out.select("entity", "n", round6("correlation").alias("correlation"), round6("p_value").alias("p_value"))


@query(None)
def distribution_methods(t: Tables) -> DataFrame:
    out = M.distribution_methods(predictions(t).select("entity", "d", "y", "s"), "entity", "d", "y", "s", 5)
    return out.select("entity", "method", "n", round6("pinball").alias("pinball"), round6("coverage").alias("coverage"))


@query(None)
def train_only_selection(t: Tables) -> DataFrame:
    """Features kept by the selection rules, a row each."""
    w = W.by_time("entity", "d")
    rows = returns(t.panel()).withColumn("r2", F.col("r") * 2).withColumn("m", ratio("close", F.lag("close", 20).over(w)) - 1).withColumn("flat", F.lit(1.0)).withColumn("rare", F.when(F.dayofmonth("d") == 15, F.col("r")))
    chosen = M.select_features(rows, ["r", "r2", "m", "flat", "rare", "value"], F.col("d") < F.lit("1999-01-01").cast("date"))
    return t.spark.range(1).select(F.posexplode(F.array(*[F.lit(c) for c in chosen])).alias("place", "feature"))


@query(None)
def spectral_regimes(t: Tables) -> DataFrame:
    """Clusters of months by the similarity of their mean state: each month and its twelve nearest by
    state, however far apart in time."""
    m = state(t).groupBy(F.trunc("d", "month").alias("m")).agg(*[F.avg(c).alias(c) for c in FEATURES]).na.drop()
    m = m.withColumn("id", F.datediff("m", F.lit("1995-01-01").cast("date")).cast("long"))
    return M.spectral_clusters(M.nearest_pairs(m, "id", FEATURES, 12), 2)
