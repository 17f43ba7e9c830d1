"""Inference, calibration, walk-forward research and portfolio queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions.expr import corr, count_if, ratio, round6, share
from chronoframe.operators import models as M
from chronoframe.operators import portfolio as Po
from chronoframe.operators import rules as R
from chronoframe.operators import splits as Sp
from chronoframe.operators import stats as S
from chronoframe.operators import windows as W
from chronoframe.operators.panel import returns
from chronoframe.plans.bindings import Tables
from chronoframe.queries.aggregates import PRED, predictions
from chronoframe.queries.joins import STATS, entity_stats
from chronoframe.queries.registry import query

PROB = PRED + """, pr AS (SELECT entity, d, CAST(y > 0 AS INT) AS label, round(1 / (1 + exp(-greatest(least(p, 5), -5))), 6) AS prob, y, p, s FROM pred WHERE y IS NOT NULL AND p IS NOT NULL)"""


def probabilities(t: Tables) -> DataFrame:
    rows = predictions(t).where("y IS NOT NULL AND p IS NOT NULL")
    return rows.withColumn("label", (F.col("y") > 0).cast("int")).withColumn("prob", round6(1 / (1 + F.exp(-F.greatest(F.least("p", F.lit(5.0)), F.lit(-5.0))))))


@query("""WITH a AS (SELECT entity, count(*) AS n, count(*) FILTER (WHERE r > 0) AS k FROM ret WHERE r IS NOT NULL GROUP BY 1), b AS (SELECT *, k / CAST(n AS DOUBLE) AS p, 1.96 * 1.96 AS z2 FROM a)
SELECT entity, n, k, round((p + z2 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n), 6) AS low, round((p + z2 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n), 6) AS high FROM b""")
def wilson_interval(t: Tables) -> DataFrame:
    a = returns(t.panel()).where("r IS NOT NULL").groupBy("entity").agg(F.count("*").alias("n"), count_if(F.col("r") > 0).alias("k"))
    low, high = S.wilson(F.col("k"), F.col("n"))
    return a.select("entity", "n", "k", round6(low).alias("low"), round6(high).alias("high"))


@query(f"""WITH {PROB}, k AS (SELECT *, rank() OVER (PARTITION BY entity ORDER BY prob) + (count(*) OVER (PARTITION BY entity, prob) - 1) / 2.0 AS r FROM pr)
SELECT entity, count(*) AS n, round((sum(r * label) - sum(label) * (sum(label) + 1) / 2.0) / nullif(CAST(sum(label) AS DOUBLE) * (count(*) - sum(label)), 0), 6) AS auc FROM k GROUP BY 1""")
def auc(t: Tables) -> DataFrame:
    return S.auc(probabilities(t), ["entity"], "label", "prob")


@query(f"""WITH {PROB} SELECT entity, round(avg((prob - label) ** 2), 6) AS brier, round(avg(-CASE WHEN label = 1 THEN ln(greatest(prob, 1e-9)) ELSE ln(greatest(1 - prob, 1e-9)) END), 6) AS log_loss, round(avg(CAST((prob >= 0.5) = (label = 1) AS INT)), 6) AS accuracy, round(avg(label), 6) AS base_rate FROM pr GROUP BY 1""")
def classification_metrics(t: Tables) -> DataFrame:
    p, y = F.col("prob"), F.col("label")
    loss = -F.when(y == 1, F.log(F.greatest(p, F.lit(1e-9)))).otherwise(F.log(F.greatest(1 - p, F.lit(1e-9))))
    return probabilities(t).groupBy("entity").agg(round6(F.avg((p - y) ** 2)).alias("brier"), round6(F.avg(loss)).alias("log_loss"), round6(share((p >= 0.5) == (y == 1))).alias("accuracy"), round6(F.avg(y)).alias("base_rate"))


@query(f"""WITH {PROB}, b AS (SELECT entity, least(floor(prob * 10), 9) AS b, count(*) AS c, avg(label) AS y, avg(prob) AS p FROM pr GROUP BY 1, 2) SELECT entity, round(sum(c * abs(y - p)) / sum(c), 6) AS ece FROM b GROUP BY 1""")
def ece(t: Tables) -> DataFrame:
    return S.calibration_error(probabilities(t), ["entity"], "label", "prob")


@query(f"""WITH {PRED}, f AS (SELECT entity, y, p - 1.2816 * s AS q10, p AS q50, p + 1.2816 * s AS q90 FROM pred WHERE y IS NOT NULL AND s IS NOT NULL), e AS (SELECT entity, y, q10, q90, greatest(0.1 * (y - q10), -0.9 * (y - q10)) AS l10, greatest(0.5 * (y - q50), -0.5 * (y - q50)) AS l50, greatest(0.9 * (y - q90), -0.1 * (y - q90)) AS l90 FROM f)
SELECT entity, round(avg(l10), 6) AS pinball_10, round(avg(l50), 6) AS pinball_50, round(avg(l90), 6) AS pinball_90, round(2 * (avg(l10) + avg(l50) + avg(l90)) / 3, 6) AS crps, round(avg(CAST(y BETWEEN q10 AND q90 AS INT)), 6) AS coverage FROM e GROUP BY 1""")
def pinball_coverage(t: Tables) -> DataFrame:
    f = predictions(t).where("y IS NOT NULL AND s IS NOT NULL").withColumn("q10", F.col("p") - 1.2816 * F.col("s")).withColumn("q90", F.col("p") + 1.2816 * F.col("s"))
    loss = lambda q, c: F.avg(F.greatest(q * (F.col("y") - F.col(c)), (q - 1) * (F.col("y") - F.col(c))))
    a, b, c = loss(0.1, "q10"), loss(0.5, "p"), loss(0.9, "q90")
    return f.groupBy("entity").agg(round6(a).alias("pinball_10"), round6(b).alias("pinball_50"), round6(c).alias("pinball_90"), round6(2 * (a + b + c) / 3).alias("crps"), round6(share(F.col("y").between(F.col("q10"), F.col("q90")))).alias("coverage"))


@query(f"""WITH {PRED}, e AS (SELECT entity, list(abs(y - p) ORDER BY abs(y - p)) AS v FROM pred WHERE y IS NOT NULL AND p IS NOT NULL AND d < DATE '1999-01-01' GROUP BY 1)
SELECT entity, CAST(len(v) AS INT) AS n, round(v[CAST(ceil((len(v) - 1) * 0.8) AS INT) + 1], 6) AS radius_80, round(v[CAST(ceil((len(v) - 1) * 0.9) AS INT) + 1], 6) AS radius_90 FROM e""")
def conformal_higher(t: Tables) -> DataFrame:
    rows = predictions(t).where(F.col("y").isNotNull() & F.col("p").isNotNull() & (F.col("d") < F.lit("1999-01-01").cast("date"))).withColumn("e", F.abs(F.col("y") - F.col("p")))
    out = S.higher_quantiles(rows, ["entity"], "e", {"radius_80": 0.8, "radius_90": 0.9})
    return out.select("entity", F.col("n").cast("int").alias("n"), round6("radius_80").alias("radius_80"), round6("radius_90").alias("radius_90"))


@query("""WITH z AS (SELECT entity, avg(r) / (stddev_samp(r) / sqrt(count(r))) AS tv FROM ret WHERE r IS NOT NULL GROUP BY 1), p AS (SELECT entity, round(exp(-0.717 * abs(tv) - 0.416 * tv * tv), 9) AS p FROM z), k AS (SELECT *, row_number() OVER (ORDER BY p, entity) AS k, count(*) OVER () AS n FROM p)
SELECT entity, round(p, 6) AS p, round(least(min(p * n / k) OVER (ORDER BY p, entity ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 6) AS q FROM k""")
def bh_fdr(t: Tables) -> DataFrame:
    z = returns(t.panel()).where("r IS NOT NULL").groupBy("entity").agg((F.avg("r") / (F.stddev_samp("r") / F.sqrt(F.count("r")))).alias("tv"))
    p = z.select("entity", F.round(F.exp(-0.717 * F.abs("tv") - 0.416 * F.col("tv") * F.col("tv")), 9).alias("p"))
    return S.bh_qvalues(p, "p", ["entity"]).select("entity", round6("p").alias("p"), round6("q").alias("q"))


@query(f"""WITH x AS (SELECT r, d < DATE '1999-01-01' AS ref FROM ret WHERE r IS NOT NULL), e AS (SELECT list_sort(list_distinct([{', '.join(f'quantile_cont(r, {k / 10}) FILTER (WHERE ref)' for k in range(11))}])) AS e, count(*) FILTER (WHERE ref) AS n, count(*) FILTER (WHERE NOT ref) AS m FROM x),
b AS (SELECT k, e[k] AS lo, e[k + 1] AS hi, k = len(e) - 1 AS last, n, m FROM e, unnest(range(1, len(e))) u(k)),
c AS (SELECT k, greatest(count(*) FILTER (WHERE ref) / any_value(n)::DOUBLE, 1e-6) AS p, greatest(count(*) FILTER (WHERE NOT ref) / any_value(m)::DOUBLE, 1e-6) AS q FROM b LEFT JOIN x ON r >= lo AND (r < hi OR (last AND r <= hi)) GROUP BY k),
z AS (SELECT sum((q - p) * ln(q / p)) AS psi FROM c) SELECT round(psi, 6) AS psi, {R.case(R.PSI_STATUS, 'stable')} AS status FROM z""")
def psi(t: Tables) -> DataFrame:
    day = F.lit("1999-01-01").cast("date")
    with S.kept(returns(t.panel()).where("r IS NOT NULL").select("d", "r")) as r:
        out = S.psi(r.where(F.col("d") < day), r.where(F.col("d") >= day), "r")
    return out.select(round6("psi").alias("psi"), "status")


NW = """z AS (SELECT entity, d, r - avg(r) OVER (PARTITION BY entity) AS z, avg(r) OVER (PARTITION BY entity) AS m FROM ret WHERE r IS NOT NULL), l AS (SELECT *, lag(z, 1) OVER w AS z1, lag(z, 2) OVER w AS z2, lag(z, 3) OVER w AS z3 FROM z WINDOW w AS (PARTITION BY entity ORDER BY d)),
g AS (SELECT entity, count(*) AS n, any_value(m) AS m, sum(z * z) / count(*) AS g0, sum(z * z1) / count(*) AS g1, sum(z * z2) / count(*) AS g2, sum(z * z3) / count(*) AS g3 FROM l GROUP BY 1)"""


@query(f"WITH {NW} SELECT entity, n, round(m / nullif(sqrt(greatest(g0 + 2 * 0.75 * g1 + 2 * 0.5 * g2 + 2 * 0.25 * g3, 0) / n), 0), 5) AS t_value FROM g")
def newey_west_t(t: Tables) -> DataFrame:
    g = S.autocovariances(returns(t.panel()), ["entity"], "d", "r", 3)
    return g.select("entity", "n", F.round(S.newey_west(g, 3), 5).alias("t_value"))


@query("""WITH z AS (SELECT entity, r - avg(r) OVER (PARTITION BY entity) AS z, row_number() OVER (PARTITION BY entity ORDER BY d) AS i, count(*) OVER (PARTITION BY entity) AS n FROM ret WHERE r IS NOT NULL),
g0 AS (SELECT entity, any_value(n) AS n, sum(z * z) AS den FROM z GROUP BY 1), k AS (SELECT entity, n, den, unnest(range(1, CAST(least(floor(sqrt(n)), n - 2) AS BIGINT) + 1)) AS k FROM g0),
a AS (SELECT k.entity, k.n, k.k, sum(x.z * y.z) / nullif(any_value(k.den), 0) AS rho FROM k JOIN z x ON x.entity = k.entity JOIN z y ON y.entity = k.entity AND y.i = x.i + k.k GROUP BY 1, 2, 3),
s AS (SELECT *, min(CASE WHEN round(rho, 12) <= 0 THEN k END) OVER (PARTITION BY entity) AS stop FROM a),
t AS (SELECT entity, sum((1 - k / n::DOUBLE) * rho) FILTER (WHERE stop IS NULL OR k < stop) AS total, max(rho) FILTER (WHERE k = 1) AS r1 FROM s GROUP BY 1)
SELECT g0.entity, n, round(n * (1 - r1) / (1 + r1), 4) AS ar1_n, round(CASE WHEN n < 3 OR den <= 0 THEN n ELSE greatest(1, least(n, n / (1 + 2 * coalesce(total, 0)))) END, 4) AS sequence_n FROM g0 LEFT JOIN t ON g0.entity = t.entity""")
def effective_n(t: Tables) -> DataFrame:
    out = S.effective_sample_size(returns(t.panel()), ["entity"], "d", "r")
    return out.select("entity", "n", F.round("ar1_n", 4).alias("ar1_n"), F.round("sequence_n", 4).alias("sequence_n"))


@query(f"""WITH {PRED}, c AS (SELECT row_number() OVER (ORDER BY d) - 1 AS s, d FROM (SELECT DISTINCT d FROM pred)), n AS (SELECT count(*) AS n FROM c), f AS (SELECT unnest([0, 1, 2, 3]) AS fold),
e AS (SELECT fold, CAST(floor(n * (0.4 + 0.15 * fold)) AS BIGINT) AS a, CAST(floor(n * (0.4 + 0.15 * (fold + 1))) AS BIGINT) AS b FROM f, n)
SELECT fold, CASE WHEN s < a - 5 THEN 'train' WHEN s < a THEN 'purged' ELSE 'test' END AS role, count(*) AS days, min(d) AS first_d, max(d) AS last_d FROM e JOIN c ON s < b GROUP BY 1, 2""")
def walk_forward_splits(t: Tables) -> DataFrame:
    c = W.sessions(t.panel(), "d").withColumn("s", F.col("session") - 1)
    n = c.agg(F.count("*").alias("n"))
    e = n.withColumn("fold", F.explode(F.array(*[F.lit(k) for k in range(4)])))
    e = e.withColumn("a", F.floor(F.col("n") * (0.4 + 0.15 * F.col("fold")))).withColumn("b", F.floor(F.col("n") * (0.4 + 0.15 * (F.col("fold") + 1))))
    rows = c.join(F.broadcast(e), F.col("s") < F.col("b"))
    role = F.when(F.col("s") < F.col("a") - 5, "train").when(F.col("s") < F.col("a"), "purged").otherwise("test")
    return rows.groupBy("fold", role.alias("role")).agg(F.count("*").alias("days"), F.min("d").alias("first_d"), F.max("d").alias("last_d"))


@query(f"""WITH {PRED}, x AS (SELECT *, ntile(4) OVER (PARTITION BY entity ORDER BY d) AS fold FROM pred WHERE y IS NOT NULL AND p IS NOT NULL), c AS (SELECT entity, fold, regr_slope(y, p) AS b, regr_intercept(y, p) AS a FROM x GROUP BY 1, 2)
SELECT x.entity, CAST(x.fold AS INTEGER) AS fold, count(*) AS n, round(avg(abs(y - (a + b * p))), 6) AS mae_model, round(avg(abs(y)), 6) AS mae_zero FROM x JOIN c ON x.entity = c.entity AND x.fold = c.fold + 1 GROUP BY 1, 2""")
def factor_screen(t: Tables) -> DataFrame:
    x = predictions(t).where("y IS NOT NULL AND p IS NOT NULL").withColumn("fold", F.ntile(4).over(W.by_time("entity", "d")))
    c = x.groupBy("entity", (F.col("fold") + 1).alias("fold")).agg(F.regr_slope("y", "p").alias("b"), F.regr_intercept("y", "p").alias("a"))
    return x.join(c, ["entity", "fold"]).groupBy("entity", "fold").agg(F.count("*").alias("n"), round6(F.avg(F.abs(F.col("y") - (F.col("a") + F.col("b") * F.col("p"))))).alias("mae_model"), round6(F.avg(F.abs("y"))).alias("mae_zero"))


@query(f"""WITH {PRED}, u AS (SELECT entity, d, year(d) AS period, y, 'mean' AS feature, p AS x FROM pred UNION ALL SELECT entity, d, year(d), y, 'spread', s FROM pred), k AS (SELECT * FROM u WHERE x IS NOT NULL AND y IS NOT NULL),
c AS (SELECT feature, period, corr(x, y) AS f FROM k GROUP BY 1, 2), l AS (SELECT feature, count(*) AS n, corr(x, y) AS ic, corr(x, y) FILTER (WHERE d >= DATE '2000-01-01') AS recent FROM k GROUP BY 1),
g AS (SELECT l.feature, any_value(n) AS n, any_value(ic) AS ic, any_value(recent) AS recent, count(DISTINCT sign(f)) FILTER (WHERE abs(f) >= 0.01) AS signs, avg(CAST(sign(f) = sign(ic) AS INT)) AS stability FROM l JOIN c ON l.feature = c.feature GROUP BY 1)
SELECT feature, n, round(ic, 5) AS ic, round(recent, 5) AS recent_ic, round(stability, 6) AS stability, {R.case(R.IC_CLASS, 'regime_dependent')} AS class FROM g""")
def feature_learning(t: Tables) -> DataFrame:
    """Long-run, recent and yearly correlations of each feature with what follows, and their class."""
    p = predictions(t)
    u = p.unpivot(["entity", "d", "y"], ["p", "s"], "feature", "x").where("x IS NOT NULL AND y IS NOT NULL").withColumn("feature", F.when(F.col("feature") == "p", "mean").otherwise("spread"))
    late = F.col("d") >= F.lit("2000-01-01").cast("date")
    folds = u.groupBy("feature", F.year("d").alias("period")).agg(corr("x", "y").alias("f"))
    long = u.groupBy("feature").agg(F.count("*").alias("n"), corr("x", "y").alias("ic"), corr(F.when(late, F.col("x")), F.when(late, F.col("y"))).alias("recent"))
    g = long.join(folds, "feature").groupBy("feature", "n", "ic", "recent").agg(F.count_distinct(F.when(F.abs("f") >= 0.01, F.signum("f"))).alias("signs"), share(F.signum("f") == F.signum("ic")).alias("stability"))
    return g.select("feature", "n", F.round("ic", 5).alias("ic"), F.round("recent", 5).alias("recent_ic"), round6("stability").alias("stability"), R.label(R.IC_CLASS, "regime_dependent").alias("class"))


@query(f"""WITH {PRED}, e AS (SELECT entity, d, y, p, lag(y, 5) OVER w AS ky, lag(p, 5) OVER w AS kp FROM pred WINDOW w AS (PARTITION BY entity ORDER BY d)), w AS (SELECT *, 1 / (avg(abs(ky - kp)) OVER z + 0.01) AS wm, 1 / (avg(abs(ky)) OVER z + 0.01) AS wz FROM e WINDOW z AS (PARTITION BY entity ORDER BY d ROWS 59 PRECEDING))
SELECT entity, d, round(wm * p / (wm + wz), 6) AS fused, round(wm / (wm + wz), 6) AS weight, CASE WHEN wm IS NULL OR p IS NULL THEN 'no_history' WHEN abs(p) > 3 THEN 'outlier' ELSE 'ok' END AS abstention FROM w""")
def fusion_weights(t: Tables) -> DataFrame:
    w = W.by_time("entity", "d")
    e = predictions(t).withColumn("ky", F.lag("y", 5).over(w)).withColumn("kp", F.lag("p", 5).over(w))
    z = W.frame(w, 60)
    e = e.withColumn("wm", 1 / (F.avg(F.abs(F.col("ky") - F.col("kp"))).over(z) + 0.01)).withColumn("wz", 1 / (F.avg(F.abs("ky")).over(z) + 0.01))
    total = F.col("wm") + F.col("wz")
    why = F.when(F.col("wm").isNull() | F.col("p").isNull(), "no_history").when(F.abs("p") > 3, "outlier").otherwise("ok")
    return e.select("entity", "d", round6(F.col("wm") * F.col("p") / total).alias("fused"), round6(F.col("wm") / total).alias("weight"), why.alias("abstention"))


@query(f"""WITH {PROB}, c AS (SELECT *, abs(prob - 0.5) AS conf, CAST((prob >= 0.5) = (label = 1) AS INT) AS ok, d < DATE '1999-01-01' AS train FROM pr), q AS (SELECT quantile_cont(conf, 0.0) AS q0, quantile_cont(conf, 0.5) AS q50, quantile_cont(conf, 0.8) AS q80 FROM c WHERE train), k AS (SELECT unnest([0, 50, 80]) AS level)
SELECT level, count(*) AS n, round(avg(ok), 6) AS accuracy FROM k, q, c WHERE NOT train AND conf >= CASE level WHEN 0 THEN q0 WHEN 50 THEN q50 ELSE q80 END GROUP BY 1""")
def selective_prediction(t: Tables) -> DataFrame:
    c = probabilities(t).withColumn("conf", F.abs(F.col("prob") - 0.5)).withColumn("ok", ((F.col("prob") >= 0.5) == (F.col("label") == 1)).cast("int")).withColumn("train", F.col("d") < F.lit("1999-01-01").cast("date"))
    q = c.where("train").agg(F.array(*[F.struct(F.lit(round(x * 100)).alias("level"), F.percentile("conf", x).alias("cut")) for x in (0.0, 0.5, 0.8)]).alias("k")).select(F.inline("k"))
    return c.where("NOT train").join(F.broadcast(q), F.col("conf") >= F.col("cut")).groupBy("level").agg(F.count("*").alias("n"), round6(F.avg("ok")).alias("accuracy"))


@query(f"""WITH {PRED}, m AS (SELECT entity, avg(y) AS m, stddev_samp(y) / sqrt(count(y)) AS se FROM pred WHERE y IS NOT NULL GROUP BY 1), b AS (SELECT *, round(m - se, 9) AS lo, round(m + se, 9) AS hi FROM m), r AS (SELECT *, min(lo) OVER (ORDER BY hi DESC, entity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low_before FROM b)
SELECT entity, round(lo, 6) AS low, round(hi, 6) AS high, CAST(sum(CASE WHEN low_before IS NULL OR hi < low_before THEN 1 ELSE 0 END) OVER (ORDER BY hi DESC, entity) AS BIGINT) AS rank_group FROM r""")
def rank_groups(t: Tables) -> DataFrame:
    """Entities whose intervals overlap a chain of better ones share a group."""
    m = predictions(t).where("y IS NOT NULL").groupBy("entity").agg(F.avg("y").alias("m"), (F.stddev_samp("y") / F.sqrt(F.count("y"))).alias("se"))
    b = m.withColumn("lo", F.round(F.col("m") - F.col("se"), 9)).withColumn("hi", F.round(F.col("m") + F.col("se"), 9))
    w = Window.orderBy(F.col("hi").desc(), "entity")
    b = b.withColumn("before", F.min("lo").over(W.before(w)))
    new = F.when(F.col("before").isNull() | (F.col("hi") < F.col("before")), 1).otherwise(0)
    return b.withColumn("new", new).select("entity", round6("lo").alias("low"), round6("hi").alias("high"), F.sum("new").over(W.so_far(w)).alias("rank_group"))


@query(None)
def bootstrap_ci(t: Tables) -> DataFrame:
    out = M.block_bootstrap(returns(t.panel()), "entity", "d", "r", 20)
    return out.select("entity", "n", *[round6(c).alias(c) for c in ("mean", "low", "high")])


@query(None)
def bootstrap_variants(t: Tables) -> DataFrame:
    """The interval of the mean by each kind of blocks, and with days drawn whole (entity 0)."""
    r = returns(t.panel())
    parts = [M.block_bootstrap(r, "entity", "d", "r", 20, kind=k).select(F.lit(k).alias("kind"), "entity", "n", "mean", "low", "high") for k in M.BOOTSTRAPS]
    parts.append(M.clustered_bootstrap(r, "d", "r").select(F.lit("clustered").alias("kind"), F.lit(0).cast("long").alias("entity"), "n", "mean", "low", "high"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("kind", "entity", "n", *[round6(c).alias(c) for c in ("mean", "low", "high")])


@query("""WITH c AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS s FROM (SELECT DISTINCT d FROM panel)), n AS (SELECT count(*) AS n, (count(*) - 250 - 40) // 4 AS size FROM c), f AS (SELECT unnest([0, 1, 2, 3]) AS k),
e AS (SELECT k, CAST(floor(n * (0.4 + 0.6 * k / 4)) AS BIGINT) AS a, CAST(floor(n * (0.4 + 0.6 * (k + 1) / 4)) AS BIGINT) AS b, 270 + k * size AS p, least(n, 270 + k * size + size) AS q, n, size FROM f, n),
u AS (SELECT 'purged' AS scheme, k AS fold, 'train' AS role, 0 AS x, p - 20 AS y FROM e WHERE n - 290 >= 80 UNION ALL SELECT 'purged', k, 'test', p, q FROM e WHERE n - 290 >= 80 UNION ALL SELECT 'expanding', k, 'train', 0, a FROM e UNION ALL SELECT 'expanding', k, 'test', a, b FROM e
  UNION ALL SELECT 'embargoed', k, 'train', 0, greatest(0, a - 20) FROM e UNION ALL SELECT 'embargoed', k, 'test', least(b, a + 20), b FROM e UNION ALL SELECT 'holdout', 0, 'train', 0, greatest(0, CAST(floor(n * 0.6) AS BIGINT) - 20) FROM n
  UNION ALL SELECT 'holdout', 0, 'validation', CAST(floor(n * 0.6) AS BIGINT), CAST(floor(n * 0.8) AS BIGINT) - 20 FROM n UNION ALL SELECT 'holdout', 0, 'holdout', CAST(floor(n * 0.8) AS BIGINT), n FROM n)
SELECT scheme, CAST(fold AS INT) AS fold, role, count(*) AS days, min(d) AS first_d, max(d) AS last_d FROM u JOIN c ON s >= x AND s < y GROUP BY 1, 2, 3""")
def split_schemes(t: Tables) -> DataFrame:
    c = W.sessions(t.panel(), "d").withColumn("s", F.col("session") - 1)
    n = c.count()
    plans = {"purged": Sp.purged(n, 20), "expanding": Sp.expanding(n), "embargoed": Sp.embargoed(n, 20), "holdout": Sp.holdout(n, 20)}
    spans = t.spark.createDataFrame([(name, *row) for name, rows in plans.items() for row in rows], "scheme string, fold int, role string, x long, y long")
    rows = c.join(F.broadcast(spans), (F.col("s") >= F.col("x")) & (F.col("s") < F.col("y")))  # a few spans by a row a day
    return rows.groupBy("scheme", "fold", "role").agg(F.count("*").alias("days"), F.min("d").alias("first_d"), F.max("d").alias("last_d"))


@query(None)
def platt_calibration(t: Tables) -> DataFrame:
    """Logistic calibration learnt before 1999, applied after."""
    day = F.lit("1999-01-01").cast("date")
    out = M.platt(probabilities(t), "prob", "label", F.col("d") < day).where(F.col("d") >= day)
    return out.select("entity", "d", "prob", round6("calibrated").alias("calibrated"))


@query(None)
def walk_forward_ridge(t: Tables) -> DataFrame:
    out = M.walk_forward_ridge(predictions(t).select("entity", "d", "y", "p", "s"), "entity", "d", ["p", "s"], "y", 5)
    return out.groupBy("entity", "fold").agg(F.count("prediction").alias("n"), round6(F.avg(F.abs(F.col("y") - F.col("prediction")))).alias("mae"))


@query(None)
def walk_forward_logistic(t: Tables) -> DataFrame:
    out = M.walk_forward_ridge(predictions(t).select("entity", "d", "y", "p", "s"), "entity", "d", ["p", "s"], "y", 5, kind="logistic")
    return out.groupBy("entity", "fold").agg(F.count("prediction").alias("n"), round6(F.avg((F.col("prediction") - (F.col("y") > 0).cast("int")) ** 2)).alias("brier"))


@query(None)
def isotonic_calibration(t: Tables) -> DataFrame:
    """Isotonic probabilities learnt before 1999, applied after."""
    from pyspark.ml.regression import IsotonicRegression

    rows = probabilities(t).select("entity", "d", F.col("label").cast("double").alias("label"), "prob")
    day = F.lit("1999-01-01").cast("date")
    model = IsotonicRegression(featuresCol="prob", labelCol="label").fit(rows.where(F.col("d") < day))
    return model.transform(rows.where(F.col("d") >= day)).select("entity", "d", "prob", round6("prediction").alias("calibrated"))


# Portfolio

@query("""WITH w AS (SELECT *, exp(sum(ln(greatest(1 + r, 1e-6))) OVER (PARTITION BY entity ORDER BY d)) AS lvl FROM ret WHERE r IS NOT NULL), p AS (SELECT *, lvl / max(lvl) OVER (PARTITION BY entity ORDER BY d) - 1 AS dd FROM w)
SELECT entity, round(stddev_samp(r) * sqrt(252), 6) AS volatility, round(sqrt(avg(least(r, 0) * least(r, 0))) * sqrt(252), 6) AS downside, round(min(dd), 6) AS max_drawdown, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252), 6) AS sharpe,
  round(avg(r) / nullif(sqrt(avg(least(r, 0) * least(r, 0))), 0) * sqrt(252), 6) AS sortino FROM p GROUP BY 1""")
def portfolio_risk(t: Tables) -> DataFrame:
    return Po.risk(returns(t.panel()).where("r IS NOT NULL")).select("entity", *[round6(c).alias(c) for c in ("volatility", "downside", "max_drawdown", "sharpe", "sortino")])


COV = """mo AS (SELECT entity, CAST(date_trunc('month', d) AS DATE) AS m, avg(r) AS r FROM ret WHERE r IS NOT NULL GROUP BY 1, 2), cov AS (SELECT a.entity AS i, b.entity AS j, covar_samp(a.r, b.r) AS c, count(*) AS n FROM mo a JOIN mo b ON a.m = b.m GROUP BY 1, 2)"""


def monthly_means(t: Tables) -> DataFrame:
    """(entity, d, r): monthly mean returns."""
    return returns(t.panel(together=True)).where("r IS NOT NULL").groupBy("entity", F.to_date(F.date_trunc("month", "d")).alias("d")).agg(F.avg("r").alias("r"))


@query(f"WITH {COV} SELECT i, j, round(c, 8) AS covariance, n FROM cov")
def covariance_matrix(t: Tables) -> DataFrame:
    return Po.covariance(monthly_means(t), 8).withColumnRenamed("c", "covariance")


@query(f"""WITH {COV}, k AS (SELECT count(DISTINCT i) AS k FROM cov), m AS (SELECT i, sum(c) / any_value(k) AS mc FROM cov, k GROUP BY 1), v AS (SELECT sum(mc) / any_value(k) AS v FROM m, k) SELECT i AS entity, round(1.0 / k, 6) AS weight, round(mc / k / sqrt(v), 6) AS contribution, round(mc / k / v, 6) AS share FROM m, v, k""")
def risk_contributions(t: Tables) -> DataFrame:
    return Po.contributions_of(monthly_means(t)).select("entity", round6("weight").alias("weight"), round6("contribution").alias("contribution"), round6("share").alias("share"))


@query(f"WITH {COV} SELECT i AS entity, round((1 / sqrt(greatest(c, 1e-12))) / sum(1 / sqrt(greatest(c, 1e-12))) OVER (), 6) AS weight FROM cov WHERE i = j")
def inverse_volatility_weights(t: Tables) -> DataFrame:
    return Po.inverse_volatility(Po.variances(monthly_means(t))).select("entity", round6("weight").alias("weight"))


@query(None)
def optimised_weights(t: Tables) -> DataFrame:
    """Minimum variance, maximum diversification, risk parity and hierarchical risk parity over every entity."""
    return Po.optimised_of(monthly_means(t)).select("method", "entity", round6("weight").alias("weight"))


@query("""WITH m AS (SELECT entity, CAST(date_trunc('month', d) AS DATE) AS m, product(1 + greatest(least(r, 0.2), -0.2)) - 1 AS mr FROM ret WHERE r IS NOT NULL GROUP BY 1, 2) SELECT entity, count(*) AS months, round(avg(mr), 6) AS mean, round(min(mr), 6) AS worst, round(avg(CAST(mr > 0 AS INT)), 6) AS positive FROM m GROUP BY 1""")
def monthly_metrics(t: Tables) -> DataFrame:
    r = F.greatest(F.least("r", F.lit(0.2)), F.lit(-0.2))
    m = returns(t.panel()).where("r IS NOT NULL").groupBy("entity", F.trunc("d", "month").alias("m")).agg((F.product(1 + r) - 1).alias("mr"))
    return m.groupBy("entity").agg(F.count("*").alias("months"), round6(F.avg("mr")).alias("mean"), round6(F.min("mr")).alias("worst"), round6(share(F.col("mr") > 0)).alias("positive"))


@query("""WITH q AS (SELECT entity, quantile_cont(r, 0.05) AS v FROM ret WHERE r IS NOT NULL GROUP BY 1) SELECT ret.entity, round(any_value(v), 6) AS var_95, round(avg(r) FILTER (WHERE r <= v), 6) AS cvar_95 FROM ret JOIN q ON ret.entity = q.entity WHERE r IS NOT NULL GROUP BY 1""")
def var_cvar(t: Tables) -> DataFrame:
    r = returns(t.panel()).where("r IS NOT NULL")
    q = r.groupBy("entity").agg(F.percentile("r", 0.05).alias("v"))
    return r.join(q, "entity").groupBy("entity").agg(round6(F.any_value("v")).alias("var_95"), round6(F.avg(F.when(F.col("r") <= F.col("v"), F.col("r")))).alias("cvar_95"))


@query("""WITH b AS (SELECT ret.entity, regr_slope(ret.r, mret.r) AS beta FROM ret JOIN mret ON ret.d = mret.d WHERE ret.r IS NOT NULL AND mret.r IS NOT NULL GROUP BY 1), p AS (SELECT entity, arg_max(close, d) AS price FROM panel GROUP BY 1)
SELECT b.entity, shock, round(price, 8) AS price, round(beta * shock, 6) AS shocked_return, round(price * (1 + beta * shock), 4) AS shocked_price FROM b JOIN p ON b.entity = p.entity, (SELECT unnest([-0.3, -0.1, 0.1])::DOUBLE AS shock)""")
def beta_shock_scenarios(t: Tables) -> DataFrame:
    m = returns(t.market().withColumn("entity", F.lit(0))).select("d", F.col("r").alias("m")).where("m IS NOT NULL")
    b = returns(t.panel()).where("r IS NOT NULL").join(m, "d").groupBy("entity").agg(F.regr_slope("r", "m").alias("beta"))
    p = t.panel().groupBy("entity").agg(F.max_by("close", "d").alias("price"))
    rows = b.join(p, "entity").withColumn("shock", F.explode(F.array(F.lit(-0.3), F.lit(-0.1), F.lit(0.1))))
    move = F.col("beta") * F.col("shock")
    return rows.select("entity", "shock", F.round("price", 8).alias("price"), round6(move).alias("shocked_return"), F.round(F.col("price") * (1 + move), 4).alias("shocked_price"))


@query("""WITH p AS (SELECT entity, arg_max(close, d) AS price FROM panel GROUP BY 1), w AS (SELECT entity, price, 10 AS lot, 1000000.0 / (SELECT count(*) FROM p) AS target FROM p) SELECT entity, CAST(floor(target / (price * lot)) * lot AS BIGINT) AS units, round(floor(target / (price * lot)) * lot * price, 2) AS spent, round(target * 0.0005, 4) AS cost FROM w""")
def lot_rounding(t: Tables) -> DataFrame:
    p = t.panel().groupBy("entity").agg(F.max_by("close", "d").alias("price"))
    w = p.join(F.broadcast(p.agg((1000000.0 / F.count("*")).alias("target"))))
    lots = F.floor(F.col("target") / (F.col("price") * 10)) * 10
    return w.select("entity", lots.cast("long").alias("units"), F.round(lots * F.col("price"), 2).alias("spent"), F.round(F.col("target") * 0.0005, 4).alias("cost"))


@query("""WITH c AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS s FROM (SELECT DISTINCT d FROM panel)), e AS (SELECT panel.entity, c.s, panel.d, close FROM panel JOIN c ON panel.d = c.d), m AS (SELECT s // 60 AS block, entity, arg_min(close, s) AS a, arg_max(close, s) AS b FROM e GROUP BY 1, 2)
SELECT block, count(*) AS n, round(avg(b / nullif(a, 0) - 1), 6) AS equal_weight FROM m GROUP BY 1""")
def non_overlapping_backtest(t: Tables) -> DataFrame:
    c = W.sessions(t.panel(), "d").withColumn("block", F.floor((F.col("session") - 1) / 60))
    m = t.panel().join(c, "d").groupBy("block", "entity").agg(F.min_by("close", "session").alias("a"), F.max_by("close", "session").alias("b"))
    return m.groupBy("block").agg(F.count("*").alias("n"), round6(F.avg(ratio("b", "a") - 1)).alias("equal_weight"))


@query(f"""WITH {COV}, k AS (SELECT count(DISTINCT i) AS k FROM cov), v AS (SELECT sum(c) / any_value(k * k) AS v FROM cov, k), m AS (SELECT i, sum(c) / any_value(k) AS mc, max(c) FILTER (WHERE i = j) AS own FROM cov, k GROUP BY 1)
SELECT i AS entity, round(sqrt(0.9 * 0.9 * v + 2 * 0.9 * 0.1 * mc + 0.01 * own) - sqrt(v), 8) AS impact FROM m, v""")
def marginal_impact(t: Tables) -> DataFrame:
    return Po.marginal_of(monthly_means(t), 0.1).select("entity", F.round("impact", 8).alias("impact"))


@query(f"""WITH {STATS}, m AS (SELECT entity, arg_max(close, d) / max(close) - 1 AS from_high FROM panel GROUP BY 1) SELECT s.entity, gain, risk, round(from_high, 6) AS from_high, round(percent_rank() OVER (ORDER BY gain) * 0.5 + percent_rank() OVER (ORDER BY risk DESC) * 0.5, 6) AS opportunity FROM s JOIN m ON s.entity = m.entity""")
def opportunity_map(t: Tables) -> DataFrame:
    m = t.panel().groupBy("entity").agg((F.max_by("close", "d") / F.max("close") - 1).alias("from_high"))
    a, b = F.percent_rank().over(Window.orderBy("gain")), F.percent_rank().over(Window.orderBy(F.col("risk").desc()))
    return entity_stats(t).join(m, "entity").select("entity", "gain", "risk", round6("from_high").alias("from_high"), round6(a * 0.5 + b * 0.5).alias("opportunity"))
