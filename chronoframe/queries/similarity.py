"""Similarity, analog, path, regime and clustering queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions.expr import count_if, ratio, round6, round_binary
from chronoframe.operators import analogs as A
from chronoframe.operators import models as M
from chronoframe.operators import rules as R
from chronoframe.operators import windows as W
from chronoframe.operators.panel import returns
from chronoframe.plans.bindings import Tables
from chronoframe.queries.panel import standard
from chronoframe.queries.registry import query

STATE = """st AS (SELECT d, close / nullif(lag(close, 20) OVER w, 0) - 1 AS mom, stddev_samp(r) OVER (w ROWS 19 PRECEDING) AS vol, close / nullif(avg(close) OVER (w ROWS 59 PRECEDING), 0) - 1 AS dist, row_number() OVER w AS pos FROM mret WINDOW w AS (ORDER BY d)),
state AS (SELECT * FROM st WHERE pos > 60)"""
FEATURES = ("mom", "vol", "dist")


def state(t: Tables) -> DataFrame:
    """(d, mom, vol, dist, pos): the market's state by day, from the 61st on."""
    m = returns(t.market().withColumn("entity", F.lit(0)))
    w = W.by_time("entity", "d")
    rows = m.select("d", (ratio("close", F.lag("close", 20).over(w)) - 1).alias("mom"), F.stddev_samp("r").over(W.frame(w, 20)).alias("vol"), (ratio("close", F.avg("close").over(W.frame(w, 60))) - 1).alias("dist"), F.row_number().over(w).cast("long").alias("pos"))
    return rows.where("pos > 60")


def _against_last(rows: DataFrame) -> DataFrame:
    """Every day before the last with the last day's values beside it (suffix _0)."""
    last = rows.groupBy().agg(*[F.max_by(c, "pos").alias(f"{c}_0") for c in (*FEATURES, "pos")])
    return rows.join(F.broadcast(last)).where("pos < pos_0")


@query(f"""WITH {STATE}, l AS (SELECT * FROM state ORDER BY pos DESC LIMIT 1), tr AS (SELECT avg(mom) AS mm, stddev_samp(mom) AS sm, avg(vol) AS mv, stddev_samp(vol) AS sv, avg(dist) AS md, stddev_samp(dist) AS sd FROM state WHERE pos < (SELECT pos FROM l)),
x AS (SELECT s.d, s.pos, sqrt(((s.mom - l.mom) / sm) ** 2 + ((s.vol - l.vol) / sv) ** 2 + ((s.dist - l.dist) / sd) ** 2) AS dist FROM state s, l, tr WHERE s.pos < l.pos)
SELECT d, pos, round(dist, 6) AS distance, round(1 / (1 + dist), 6) AS similarity FROM x""")
def analog_zscore(t: Tables) -> DataFrame:
    s = state(t)
    n = s.agg(F.max("pos").alias("end"))
    z = A.z_scaled(s.join(F.broadcast(n)), FEATURES, F.col("pos") < F.col("end")).drop("end")
    x = _against_last(z).withColumn("x", F.sqrt(sum(((F.col(c) - F.col(f"{c}_0")) ** 2 for c in FEATURES), F.lit(0.0))))
    return x.select("d", "pos", round6("x").alias("distance"), round6(1 / (1 + F.col("x"))).alias("similarity"))


@query(f"""WITH {STATE}, l AS (SELECT * FROM state ORDER BY pos DESC LIMIT 1), tr AS (SELECT {', '.join(f'quantile_cont({c}, 0.5) AS m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS q_{c}' for c in FEATURES)} FROM state WHERE pos < (SELECT pos FROM l)),
z AS (SELECT d, pos, {', '.join(f'greatest(least((coalesce(s.{c}, m_{c}) - m_{c}) / coalesce(nullif(q_{c}, 0), 1), 12), -12) AS {c}' for c in FEATURES)} FROM state s, tr)
SELECT z.d, z.pos, round(sqrt(((z.mom - k.mom) ** 2 + (z.vol - k.vol) ** 2 + (z.dist - k.dist) ** 2) / 3), 6) AS rms FROM z, (SELECT * FROM z ORDER BY pos DESC LIMIT 1) k WHERE z.pos < k.pos""")
def analog_robust(t: Tables) -> DataFrame:
    s = state(t)
    n = s.agg(F.max("pos").alias("end"))
    z = A.robust_scaled(s.join(F.broadcast(n)), FEATURES, F.col("pos") < F.col("end")).drop("end")
    x = _against_last(z)
    return x.select("d", "pos", round6(A.rms_distance(F.array(*FEATURES), F.array(*[f"{c}_0" for c in FEATURES]))).alias("rms"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0), x AS (SELECT query_id, v.vec_id, round(list_cosine_similarity(e::DOUBLE[], v.embedding::DOUBLE[]), 9) AS c FROM q, embeddings v WHERE v.vec_id <> query_id)
SELECT query_id, vec_id, CAST(rank AS INT) AS rank, round(c, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank FROM x) WHERE rank <= 5""")
def embedding_knn(t: Tables) -> DataFrame:
    """Five nearest by cosine to every hundredth vector, in blocks of queries against all rows."""
    return M.nearest(t("embeddings"), "vec_id", "embedding", F.col("vec_id") % 100 == 0, 5).select("query_id", "vec_id", "rank", round6("cosine").alias("cosine"))


@query(f"""WITH {STATE}, l AS (SELECT * FROM state ORDER BY pos DESC LIMIT 1), x AS (SELECT s.d, s.pos, abs(s.mom - l.mom) AS a, abs(s.vol - l.vol) AS b FROM state s, l WHERE s.pos < l.pos),
r AS (SELECT *, (rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0) / count(*) OVER () AS ra, (rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0) / count(*) OVER () AS rb FROM x)
SELECT d, pos, round(0.6 * ra + 0.4 * rb, 6) AS blend FROM r""")
def rank_blend(t: Tables) -> DataFrame:
    x = _against_last(state(t)).withColumn("a", F.abs(F.col("mom") - F.col("mom_0"))).withColumn("b", F.abs(F.col("vol") - F.col("vol_0"))).withColumn("k", F.lit(1))
    return x.select("d", "pos", round6(0.6 * W.percentile_rank("a", ["k"]) + 0.4 * W.percentile_rank("b", ["k"])).alias("blend"))


@query(f"""WITH {STATE}, l AS (SELECT * FROM state ORDER BY pos DESC LIMIT 1), x AS (SELECT s.d, s.pos, abs(s.mom - l.mom) AS a, CASE WHEN s.pos % 3 = 0 THEN NULL ELSE abs(s.vol - l.vol) END AS b, abs(s.dist - l.dist) AS c FROM state s, l WHERE s.pos < l.pos),
y AS (SELECT *, (0.5 * a + 0.3 * coalesce(b, 0) + 0.2 * c) / (0.7 + CASE WHEN b IS NULL THEN 0 ELSE 0.3 END) AS f FROM x) SELECT d, pos, round(f, 6) AS distance, round(100 * exp(-f), 4) AS score, CASE WHEN 100 * exp(-f) >= 90 THEN 'strong' WHEN 100 * exp(-f) >= 70 THEN 'usable' ELSE 'weak' END AS tier FROM y""")
def family_distance(t: Tables) -> DataFrame:
    x = _against_last(state(t))
    gap = lambda c: F.abs(F.col(c) - F.col(f"{c}_0"))
    f = A.family_distance({"a": gap("mom"), "b": F.when(F.col("pos") % 3 != 0, gap("vol")), "c": gap("dist")}, {"a": 0.5, "b": 0.3, "c": 0.2})
    x = x.withColumn("f", f).withColumn("s", 100 * F.exp(-F.col("f")))
    return x.select("d", "pos", round6("f").alias("distance"), F.round("s", 4).alias("score"), F.when(F.col("s") >= 90, "strong").when(F.col("s") >= 70, "usable").otherwise("weak").alias("tier"))


PATHS = """paths AS (SELECT entity, d, close AS c0, list(close) OVER (PARTITION BY entity ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS p FROM panel), np AS (SELECT entity, d, list_transform(p, lambda x: round(x / c0 - 1, 9)) AS v FROM paths WHERE len(p) = 20)"""


def paths(t: Tables) -> DataFrame:
    """(entity, d, v): the 20 forward returns of every day that has them."""
    w = W.by_time("entity", "d").rowsBetween(1, 20)
    rows = t.panel().select("entity", "d", F.col("close").alias("c0"), F.collect_list("close").over(w).alias("p"))
    return rows.where(F.size("p") == 20).select("entity", "d", F.expr("transform(p, x -> round(x / c0 - 1, 9))").alias("v"))


@query(f"""WITH {PATHS}, u AS (SELECT *, list_position(list_transform(v, lambda x: x >= 0.5), true) AS up, list_position(list_transform(v, lambda x: x <= -0.5), true) AS dn FROM np)
SELECT entity, d, CASE WHEN coalesce(dn, 0) > 0 AND (coalesce(up, 0) = 0 OR dn <= up) THEN 'lower' WHEN coalesce(up, 0) > 0 THEN 'upper' ELSE 'neither' END AS side, CAST(least(nullif(up, 0), nullif(dn, 0)) AS INTEGER) AS session FROM u""")
def first_passage(t: Tables) -> DataFrame:
    return paths(t).withColumn("x", A.first_passage(F.col("v"), 0.5, -0.5)).select("entity", "d", "x.side", "x.session")


PATH_FACTS = """ps AS (SELECT entity, d, list_prepend(0.0::DOUBLE, v) AS p FROM np), pq AS (SELECT *, list_min(p) AS lo, list_max(p) AS hi, p[-1] AS e, list_position(p, list_min(p)) - 1 AS tt, list_position(p, list_max(p)) - 1 AS tp,
  list_min(list_transform(p, lambda x, i: (1 + x) / (1 + list_max(p[1:i])) - 1)) AS dd FROM ps), pr AS (SELECT *, nullif(list_position(list_transform(p, lambda x, i: x >= 0 AND i - 1 > tt), true), 0) - 1 AS rec FROM pq),
pf AS (SELECT *, e < 0 AS underwater, lo < 0 AND rec IS NOT NULL AS recovered, coalesce(rec + 1 < len(p) AND list_max(p[rec + 2:]) > 0, false) AS new_high, lo < 0 AND e > 0 AND tt < len(p) - 1 AS fall_first FROM pr)"""


@query(f"""WITH {PATHS}, {PATH_FACTS} SELECT entity, d, round(lo, 6) AS mae, round(hi, 6) AS mfe, round(dd, 6) AS max_drawdown, CAST(tt AS INT) AS time_to_trough, CAST(tp AS INT) AS time_to_peak, round(e, 6) AS terminal, underwater, recovered, CAST(rec AS INT) AS recovery_time,
  new_high AS new_high_after_recovery, fall_first AS fall_first_end_positive FROM pf""")
def path_statistics(t: Tables) -> DataFrame:
    out = A.path_statistics(paths(t).withColumn("v", F.concat(F.array(F.lit(0.0)), "v")), "v")
    return out.select("entity", "d", *[round6(c).alias(c) for c in ("mae", "mfe", "max_drawdown")], "time_to_trough", "time_to_peak", round6("terminal").alias("terminal"), "underwater", "recovered", "recovery_time", "new_high_after_recovery", "fall_first_end_positive")


@query(f"""WITH {PATHS}, {PATH_FACTS}, w AS (SELECT *, 1.0 / (1 + (DATE '2001-12-31' - d) / 365.0) AS wt FROM pf), s AS (SELECT *, wt / sum(wt) OVER (PARTITION BY entity) AS sw FROM w),
c AS (SELECT *, sum(sw) OVER (PARTITION BY entity ORDER BY dd RANGE UNBOUNDED PRECEDING) AS cd FROM s)
SELECT entity, count(*) AS n, round(1 / sum(sw * sw), 4) AS effective_n, round(min(dd) FILTER (WHERE cd >= 0.5 - 1e-12), 6) AS median_drawdown, round(sum(sw) FILTER (WHERE underwater), 6) AS underwater, round(coalesce(sum(sw) FILTER (WHERE recovered), 0), 6) AS recovered,
  round(coalesce(sum(sw) FILTER (WHERE new_high), 0), 6) AS new_high_after_recovery, round(coalesce(sum(sw) FILTER (WHERE fall_first), 0), 6) AS fall_first_end_positive, {', '.join(f'round(coalesce(sum(sw) FILTER (WHERE dd <= -{x}), 0), 6) AS drawdown_{round(x * 100)}' for x in (0.03, 0.05, 0.10, 0.15, 0.20))} FROM c GROUP BY 1""")
def path_risk(t: Tables) -> DataFrame:
    """What the paths of an entity did, later ones counting more."""
    p = A.path_statistics(paths(t).withColumn("v", F.concat(F.array(F.lit(0.0)), "v")), "v")
    p = p.withColumn("weight", 1.0 / (1 + F.datediff(F.lit("2001-12-31").cast("date"), "d") / 365.0))
    out = A.path_risk(p, ["entity"], "weight")
    return out.select("entity", "n", F.round("effective_n", 4).alias("effective_n"), *[round6(c).alias(c) for c in out.columns if c not in ("entity", "n", "effective_n")])


@query(f"""WITH {PATHS}, w AS (SELECT entity, d, v[20] AS x, 1.0 / (1 + (DATE '2001-12-31' - d) / 365.0) AS wt FROM np), c AS (SELECT *, sum(wt) OVER (PARTITION BY entity ORDER BY x RANGE UNBOUNDED PRECEDING) AS cw, sum(wt) OVER (PARTITION BY entity) AS tw FROM w)
SELECT entity, round(min(x) FILTER (WHERE cw >= 0.1 * tw - 1e-12), 6) AS q10, round(min(x) FILTER (WHERE cw >= 0.5 * tw - 1e-12), 6) AS q50, round(min(x) FILTER (WHERE cw >= 0.9 * tw - 1e-12), 6) AS q90, round(sum(wt) * sum(wt) / sum(wt * wt), 6) AS effective_n FROM c GROUP BY 1""")
def weighted_quantiles(t: Tables) -> DataFrame:
    w = paths(t).select("entity", F.element_at("v", -1).alias("x"), (1.0 / (1 + F.datediff(F.lit("2001-12-31").cast("date"), "d") / 365.0)).alias("wt"))
    q = A.weighted_quantile(w, ["entity"], "x", "wt", (0.1, 0.5, 0.9))
    ess = w.groupBy("entity").agg(round6(A.effective_sample("wt")).alias("effective_n"))
    return q.join(ess, "entity").select("entity", *[round6(c).alias(c) for c in ("q10", "q50", "q90")], "effective_n")


@query(f"""WITH {PATHS}, x AS (SELECT entity, d, v[20] AS x FROM np), s AS (SELECT *, sum(x) OVER e AS s, count(*) OVER e AS n FROM x WINDOW e AS (PARTITION BY entity)) SELECT entity, n, round(any_value(s) / n, 6) AS mean, round(min((s - x) / nullif(n - 1, 0)), 6) AS low, round(max((s - x) / nullif(n - 1, 0)), 6) AS high,
  count(*) FILTER (WHERE sign(s - x) <> sign(s)) AS flips FROM s GROUP BY entity, n""")
def leave_one_out(t: Tables) -> DataFrame:
    e = Window.partitionBy("entity")
    x = paths(t).select("entity", F.element_at("v", -1).alias("x")).withColumn("s", F.sum("x").over(e)).withColumn("n", F.count(F.lit(1)).over(e))
    rest = ratio(F.col("s") - F.col("x"), (F.col("n") - 1).cast("double"))
    return x.groupBy("entity", "n").agg(round6(F.any_value("s") / F.col("n")).alias("mean"), round6(F.min(rest)).alias("low"), round6(F.max(rest)).alias("high"), count_if(F.signum(F.col("s") - F.col("x")) != F.signum("s")).alias("flips"))


@query(f"""WITH {PATHS}, e AS (SELECT entity, d, unnest(v) AS x, generate_subscripts(v, 1) AS s FROM np) SELECT entity, CAST(s AS INT) AS session, count(*) AS n, round(quantile_cont(x, 0.1), 6) AS q10, round(quantile_cont(x, 0.5), 6) AS q50, round(quantile_cont(x, 0.9), 6) AS q90 FROM e GROUP BY 1, 2""")
def projection_bands(t: Tables) -> DataFrame:
    e = paths(t).select("entity", F.posexplode("v").alias("s", "x"))
    q = [round6(F.percentile("x", p)).alias(f"q{round(p * 100)}") for p in (0.1, 0.5, 0.9)]
    return e.groupBy("entity", (F.col("s") + 1).alias("session")).agg(F.count("*").alias("n"), *q)


@query(f"""WITH {PATHS}, m AS (SELECT a.entity, a.d, round(avg(list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2]))) / 20), 9) AS x FROM np a JOIN np b ON a.entity = b.entity GROUP BY 1, 2)
SELECT entity, d, round(x, 5) AS mean_difference FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY x, d) AS n FROM m) WHERE n = 1""")
def medoid_path(t: Tables) -> DataFrame:
    """The path with the least mean distance to the entity's others.  A session's sum of absolute
    differences to all others comes from ranks and running sums: no pairs of paths are made."""
    e = paths(t).select("entity", "d", F.posexplode("v").alias("s", "x"))
    p = Window.partitionBy("entity", "s")
    o = p.orderBy("x", "d")
    k, n = F.row_number().over(o), F.count(F.lit(1)).over(p)
    run, total = F.sum("x").over(o.rowsBetween(Window.unboundedPreceding, 0)), F.sum("x").over(p)
    e = e.withColumn("a", (F.col("x") * (2 * k - n) - 2 * run + total) / n)
    m = e.groupBy("entity", "d").agg(F.round(F.sum("a") / 20, 9).alias("m"))
    return W.latest(m, ["entity"], [F.col("m"), F.col("d")]).select("entity", "d", F.round("m", 5).alias("mean_difference"))


@query(f"""WITH {PATHS}, c AS (SELECT v[20] AS terminal, list_min(v) AS low, list_max(v) AS high FROM np) SELECT {R.case(R.SCENARIO, 'volatile_mixed')} AS scenario, count(*) AS n, round(avg(terminal), 6) AS mean_end FROM c GROUP BY 1""")
def scenario_classes(t: Tables) -> DataFrame:
    c = paths(t).select(F.element_at("v", -1).alias("terminal"), F.array_min("v").alias("low"), F.array_max("v").alias("high"))
    return c.groupBy(R.label(R.SCENARIO, "volatile_mixed").alias("scenario")).agg(F.count("*").alias("n"), round6(F.avg("terminal")).alias("mean_end"))


REPLAY = f"""WITH {STATE}, c AS (SELECT pos AS cutoff, mom AS m0, vol AS v0 FROM state), x AS (SELECT cutoff, s.pos, abs(s.mom - m0) + abs(s.vol - v0) AS dist FROM c JOIN state s ON s.pos < cutoff - 20), n AS (SELECT *, row_number() OVER (PARTITION BY cutoff ORDER BY round(dist, 9), pos) AS k FROM x),
f AS (SELECT pos, lead(close, 20) OVER (ORDER BY d) / nullif(close, 0) - 1 AS y FROM (SELECT d, close, row_number() OVER (ORDER BY d) AS pos FROM market))
SELECT n.cutoff, count(*) AS analogs, round(avg(f.y), 6) AS forecast, round(max(a.y), 6) AS actual FROM n JOIN f ON n.pos = f.pos LEFT JOIN f a ON a.pos = n.cutoff WHERE k <= 15 GROUP BY 1"""


def replay(t: Tables, stride: int) -> DataFrame:
    """A cutoff at every stride-th state; a state counts once its outcome is known."""
    s = state(t)
    c = s.where(F.col("pos") % stride == 0).select(F.col("pos").alias("cutoff"), F.col("mom").alias("m0"), F.col("vol").alias("v0"))
    x = s.join(F.broadcast(c), F.col("pos") < F.col("cutoff") - 20).withColumn("x", F.round(F.abs(F.col("mom") - F.col("m0")) + F.abs(F.col("vol") - F.col("v0")), 9))
    n = W.top_k(x, ["cutoff"], [F.col("x"), F.col("pos")], 15, "k").select("cutoff", "pos")
    w = Window.orderBy("d")
    f = t.market().select(F.row_number().over(w).cast("long").alias("pos"), (ratio(F.lead("close", 20).over(w), "close") - 1).alias("y"))
    actual = f.select(F.col("pos").alias("cutoff"), F.col("y").alias("actual"))
    return n.join(f, "pos").join(actual, "cutoff", "left").groupBy("cutoff").agg(F.count("*").alias("analogs"), round6(F.avg("y")).alias("forecast"), round6(F.max("actual")).alias("actual"))


@query(REPLAY)
def walk_forward_replay(t: Tables) -> DataFrame:
    """Forecasts from the nearest states known at every state; a state counts once its outcome is known."""
    return replay(t, 1)


@query(None)
def dtw_paths(t: Tables) -> DataFrame:
    """Dynamic time warping distance of each path to its entity's first path."""
    p = paths(t)
    first = p.groupBy("entity").agg(F.min_by("v", "d").alias("v0"))
    return M.dtw_distance(p.join(first, "entity"), "v", "v0").select("entity", "d", round6("dtw").alias("dtw"))


@query(f"""WITH {PATHS}, f AS (SELECT entity, arg_min(v, d) AS v0 FROM np GROUP BY 1), j AS (SELECT np.entity, d, list_sum(list_transform(list_zip(v, v0), lambda z: z[1] * z[2])) AS xy, list_sum(list_transform(v, lambda z: z * z)) AS xx, list_sum(list_transform(v0, lambda z: z * z)) AS yy FROM np JOIN f ON np.entity = f.entity)
SELECT entity, d, round(1 - xy / nullif(sqrt(xx) * sqrt(yy), 0), 6) AS distance FROM j""")
def path_cosines(t: Tables) -> DataFrame:
    """Cosine distance of each path to its entity's first path."""
    p = paths(t)
    first = p.groupBy("entity").agg(F.min_by("v", "d").alias("v0"))
    return p.join(first, "entity").select("entity", "d", round6(A.path_cosine("v", "v0")).alias("distance"))


@query(None)
def state_distances_mahalanobis(t: Tables) -> DataFrame:
    """Shrunk Mahalanobis and PCA distances of vectors to their mean."""
    return M.covariance_distances(t("embeddings"), "vec_id", "embedding", 5).select("vec_id", F.round("mahalanobis", 4).alias("mahalanobis"), F.round("pca", 4).alias("pca"))


# Regimes

MARKET = """mk AS (SELECT d, row_number() OVER w AS pos, close / max(close) OVER w - 1 AS drawdown, CASE WHEN count(r) OVER (w ROWS 19 PRECEDING) >= 20 THEN stddev_samp(r) OVER (w ROWS 19 PRECEDING) * sqrt(252) END AS vol, close / nullif(lag(close, 20) OVER w, 0) - 1 AS r20, close / nullif(lag(close, 60) OVER w, 0) - 1 AS r60,
  CASE WHEN count(close) OVER (w ROWS 49 PRECEDING) >= 50 THEN close / avg(close) OVER (w ROWS 49 PRECEDING) - 1 END AS p50, CASE WHEN count(close) OVER (w ROWS 199 PRECEDING) >= 200 THEN avg(close) OVER (w ROWS 199 PRECEDING) END AS sma, close FROM mret WINDOW w AS (ORDER BY d)),
mf AS (SELECT d, pos, drawdown, vol, r20, r60, p50, close / sma - 1 AS p200, sma / nullif(lag(sma, 5) OVER (ORDER BY d), 0) - 1 AS slope FROM mk)"""


def market_facts(t: Tables) -> DataFrame:
    """(d, pos, drawdown, vol, r20, r60, p50, p200, slope) of the market, a row a day."""
    w = W.by_time("entity", "d")
    m = returns(t.market().withColumn("entity", F.lit(0)))
    mean = lambda n: W.rolling(F.avg("close"), F.col("close"), W.frame(w, n), n)
    back = lambda n: ratio("close", F.lag("close", n).over(w)) - 1
    m = m.select("entity", "d", "close", F.row_number().over(w).cast("long").alias("pos"), (F.col("close") / F.max("close").over(W.so_far(w)) - 1).alias("drawdown"), (W.rolling(F.stddev_samp("r"), F.col("r"), W.frame(w, 20), 20) * 252**0.5).alias("vol"),
                 back(20).alias("r20"), back(60).alias("r60"), (F.col("close") / mean(50) - 1).alias("p50"), mean(200).alias("sma"))
    return m.select("d", "pos", "drawdown", "vol", "r20", "r60", "p50", (F.col("close") / F.col("sma") - 1).alias("p200"), (ratio("sma", F.lag("sma", 5).over(w)) - 1).alias("slope"))


REASONS = "CASE regime " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.REGIME_REASONS.items()) + " END"


@query(f"""WITH {MARKET}, g AS (SELECT d, {R.case(R.REGIME, R.REGIME_ELSE)} AS regime FROM mf) SELECT d, regime, {REASONS} AS reasons FROM g""")
def regime_rules(t: Tables) -> DataFrame:
    return market_facts(t).select("d", R.label(R.REGIME, R.REGIME_ELSE).alias("regime")).withColumn("reasons", F.expr(REASONS))


RATES = """ob AS (SELECT series, available, value FROM (SELECT *, row_number() OVER (PARTITION BY series, available ORDER BY vintage DESC) AS n FROM observations WHERE series IN ('1-URGENT', '5-LOW')) WHERE n = 1),
lv AS (SELECT g.d, round(avg(o.value), 6) AS level FROM (SELECT d, s FROM market, (SELECT unnest(['1-URGENT', '5-LOW']) AS s)) g ASOF JOIN ob o ON g.s = o.series AND g.d >= o.available GROUP BY 1)"""


def rate_level(t: Tables) -> DataFrame:
    """(d, level): mean of two series' values known at each day."""
    from chronoframe.operators.joins import asof

    names = ["1-URGENT", "5-LOW"]
    known = W.latest(t.observations().where(F.col("series").isin(names)), ["series", "available"], [F.col("vintage").desc()])
    grid = t.market().select("d", F.explode(F.array(*[F.lit(n) for n in names])).alias("series"))
    return asof(grid, known, ["series"], "d", "available", ["value"], inner=True, bucket="quarter").groupBy("d").agg(round6(F.avg("value")).alias("level"))


@query(f"""WITH {MARKET}, {RATES}, q AS (SELECT mf.d, pos, r60 AS ret60, drawdown, vol, level, {', '.join(f'quantile_cont(vol, 0.{x}) OVER h AS q{x}' for x in (25, 75, 90))}, count(vol) OVER h AS n FROM mf LEFT JOIN lv ON mf.d = lv.d WINDOW h AS (ORDER BY pos)),
v AS (SELECT *, {R.case(R.VOLATILITY_REGIME, 'normal')} AS volatility, {R.case(R.MARKET_TREND, 'strong_bull')} AS market_trend FROM q),
x AS (SELECT d, market_trend, volatility, level, count(level) OVER h AS n, level - lag(level, 20) OVER (ORDER BY pos) AS change, nullif(stddev_samp(level) OVER h, 0) * 0.1 AS meaningful, quantile_cont(level, 0.75) OVER h AS q75 FROM v WINDOW h AS (ORDER BY pos))
SELECT d, market_trend, volatility, {R.case(R.RATES_REGIME, 'stable_normal')} AS rates FROM x""")
def regime_dimensions(t: Tables) -> DataFrame:
    """Trend, volatility and rates of the market by day, against what was known by then (a row a day)."""
    facts = market_facts(t).withColumnRenamed("r60", "ret60").join(rate_level(t), "d", "left").withColumn("k", F.lit(1))
    return A.regime_dimensions(facts, "pos", ["k"]).select("d", "market_trend", "volatility", "rates")


@query(f"""WITH x AS (SELECT entity, d, close / nullif(lag(close, 20) OVER w, 0) - 1 AS r20, close / nullif(lag(close, 60) OVER w, 0) - 1 AS r60, close / nullif(max(close) OVER w, 0) - 1 AS drawdown, close / nullif(avg(close) OVER (w ROWS 19 PRECEDING), 0) - 1 AS p20 FROM panel WINDOW w AS (PARTITION BY entity ORDER BY d))
SELECT entity, d, {R.case(R.STOCK_STATE, 'sideways')} AS stock_state FROM x""")
def stock_states(t: Tables) -> DataFrame:
    w = W.by_time("entity", "d")
    back = lambda n: ratio("close", F.lag("close", n).over(w)) - 1
    x = t.panel().select("entity", "d", back(20).alias("r20"), back(60).alias("r60"), (ratio("close", F.max("close").over(W.so_far(w))) - 1).alias("drawdown"), (ratio("close", F.avg("close").over(W.frame(w, 20))) - 1).alias("p20"))
    return x.select("entity", "d", R.label(R.STOCK_STATE, "sideways").alias("stock_state"))


def _bound(x: str, scale: float) -> str:
    return f"coalesce(greatest(-1.0, least(1.0, CASE WHEN {x} IS NOT NULL THEN ({x}) / ({scale}) END)) * CASE WHEN {x} IS NOT NULL THEN 1 END, 0.0)"


_BLOCKS = {"trend": f"({_bound('price_to_sma_50', 0.1)} + {_bound('price_to_sma_200', 0.2)}) / 2", "momentum": f"({_bound('return_20', 0.1)} + {_bound('return_60', 0.2)}) / 2", "relative_strength": _bound("relative_strength_60", 0.15),
           "risk": f"-({_bound('volatility_60', 0.5)} + {_bound('current_drawdown', -0.3)}) / 2", "liquidity": _bound("(CASE WHEN coalesce(turnover_to_mean_20, 0) = 0 THEN 1.0 ELSE turnover_to_mean_20 END - 1)", 1.0),
           "market_regime": "CASE regime " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in R.REGIME_SCORE.items()) + " ELSE 0.0 END", "historical_analogues": _bound("(frequency - 0.5)", 0.25)}


@query(f"""WITH {MARKET}, g AS (SELECT d, {R.case(R.REGIME, R.REGIME_ELSE)} AS regime FROM mf),
y AS (SELECT entity, d, lead(close, 20) OVER w / nullif(close, 0) - 1 AS y FROM panel WINDOW w AS (PARTITION BY entity ORDER BY d)), k AS (SELECT *, lag(y, 20) OVER (PARTITION BY entity ORDER BY d) AS known FROM y),
f AS (SELECT entity, d, avg(CAST(known > 0 AS INT)) OVER w AS frequency, count(known) OVER w AS n FROM k WINDOW w AS (PARTITION BY entity ORDER BY d ROWS 249 PRECEDING)),
x AS (SELECT feat.entity, feat.d, f.n, {', '.join(f'{v} AS block_{k}' for k, v in _BLOCKS.items())} FROM feat JOIN f ON feat.entity = f.entity AND feat.d = f.d JOIN g ON feat.d = g.d),
z AS (SELECT *, {' + '.join(f'{R.BLOCK_WEIGHT[k]} * block_{k}' for k in _BLOCKS)} AS total FROM x)
SELECT entity, d, n, {', '.join(f'round(block_{k}, 6) AS block_{k}' for k in _BLOCKS)}, round(total, 6) AS total, {R.case(R.STATUS, R.STATUS_ELSE)} AS status FROM z""")
def score_blocks(t: Tables) -> DataFrame:
    """Seven blocks an entity and day; the analogues' part is the share of gains among the outcomes of
    20 rows known by then, taken on the features' own rows: one shuffle by entity serves both."""
    from chronoframe.operators.joins import small
    from chronoframe.operators.scoring import blocks

    g = small(market_facts(t).select("d", R.label(R.REGIME, R.REGIME_ELSE).alias("regime")))
    w = W.by_time("entity", "d")
    p = t.panel(together=True).where("entity IS NOT NULL").select("entity", "d", "close", "value", "volume")
    y = p.withColumn("y", ratio(F.lead("close", 20).over(w), "close") - 1).withColumn("known", F.lag("y", 20).over(w))
    f = y.select(*p.columns, F.avg((F.col("known") > 0).cast("int")).over(W.frame(w, 250)).alias("frequency"), F.count("known").over(W.frame(w, 250)).alias("n"))
    out = blocks(standard(t, f).join(g, "d"))
    return out.select("entity", "d", "n", *[round_binary(f"block_{k}", 6).alias(f"block_{k}") for k in R.BLOCK_WEIGHT], round_binary("total", 6).alias("total"), "status")


@query(f"""WITH {STATE}, n AS (SELECT max(pos) - 500 AS cut FROM state), c AS (SELECT {', '.join(f'median({f}) AS c_{f}' for f in FEATURES)} FROM state, n WHERE pos <= cut), x AS (SELECT d, pos, pos <= cut AS train, round(sqrt(({' + '.join(f'({f} - c_{f}) ** 2' for f in FEATURES)}) / {len(FEATURES)}), 9) AS x FROM state, c, n), r AS (SELECT list_sort(list(x)) AS ref, count(*) AS k FROM x WHERE train)
SELECT d, round(x, 6) AS distance, round(p, 6) AS percentile, {R.case(R.NOVELTY, 'historically_novel')} AS label FROM (SELECT d, x, len(list_filter(ref, lambda y: y <= x.x)) / CAST(k AS DOUBLE) AS p FROM x, r)""")
def novelty_percentile(t: Tables) -> DataFrame:
    """Distance to the training rows' median, and the share of their own distances at or below it."""
    s = state(t)
    s = s.join(F.broadcast(s.agg((F.max("pos") - 500).alias("cut")))).withColumn("train", F.col("pos") <= F.col("cut"))
    out = A.novelty(s, FEATURES, F.col("train"))
    return out.select("d", round6("distance").alias("distance"), round6("p").alias("percentile"), R.label(R.NOVELTY, "historically_novel").alias("label"))


@query(None)
def kmeans_regimes(t: Tables) -> DataFrame:
    """Cluster number by day, k chosen by silhouette over 2..4."""
    return M.cluster_states(state(t).na.drop(), list(FEATURES), "kmeans", (2, 3, 4)).select("d", "cluster")


@query(None)
def regime_candidates(t: Tables) -> DataFrame:
    """Two to six clusters by k-means and by mixtures, scored on the later three tenths."""
    out = M.regime_candidates(state(t).na.drop(), list(FEATURES), "pos")
    return out.select("algorithm", "k", *[F.round(c, 4).alias(c) for c in out.columns[2:]])


@query(None)
def mixture_regimes(t: Tables) -> DataFrame:
    return M.cluster_states(state(t).na.drop(), list(FEATURES), "gmm", (2, 3)).select("d", "cluster")


@query(None)
def hidden_markov_regimes(t: Tables) -> DataFrame:
    """Viterbi path of a Gaussian mixture's components with smoothed transition counts, by entity."""
    rows = returns(t.panel()).where("r IS NOT NULL").select("entity", "d", "r")
    return M.viterbi_by_entity(rows, "entity", "d", "r", 3).select("entity", "d", "state")


