"""Aggregate, window and run queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions.expr import corr, count_if, ratio, round6, share
from chronoframe.operators import panel as P
from chronoframe.operators import rules as R
from chronoframe.operators import stats as S
from chronoframe.operators import windows as W
from chronoframe.operators.panel import returns
from chronoframe.plans.bindings import Tables
from chronoframe.queries.registry import query


@query("SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(t: Tables) -> DataFrame:
    return t("orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("n")).where("n > 1")


@query("""SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_discount > 0.05) AS discounted, round(avg(l_extendedprice) FILTER (WHERE l_tax > 0.02), 4) AS taxed_price,
  sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS open_quantity FROM lineitem GROUP BY 1""")
def filtered_aggregates(t: Tables) -> DataFrame:
    return t("lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), count_if(F.col("l_discount") > 0.05).alias("discounted"), F.round(F.avg(F.when(F.col("l_tax") > 0.02, F.col("l_extendedprice"))), 4).alias("taxed_price"),
                                                     F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))).alias("open_quantity"))


@query("""SELECT c_mktsegment, round(median(c_acctbal), 6) AS median, round(quantile_cont(c_acctbal, 0.25), 6) AS q25, round(quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25), 6) AS iqr,
  round(stddev_samp(c_acctbal), 6) AS sd, round(stddev_pop(c_acctbal), 6) AS sdp, round(corr(c_acctbal, c_nationkey), 6) AS corr FROM customer GROUP BY 1""")
def distribution_aggregates(t: Tables) -> DataFrame:
    b = "c_acctbal"
    return t("customer").groupBy("c_mktsegment").agg(round6(F.median(b)).alias("median"), round6(F.percentile(b, 0.25)).alias("q25"), round6(F.percentile(b, 0.75) - F.percentile(b, 0.25)).alias("iqr"),
                                                     round6(F.stddev_samp(b)).alias("sd"), round6(F.stddev_pop(b)).alias("sdp"), round6(corr(b, "c_nationkey")).alias("corr"))


@query("SELECT entity, arg_max(close, d) AS last_close, arg_min(close, d) AS first_close, max(d) AS last_d FROM panel GROUP BY 1")
def arg_max_last(t: Tables) -> DataFrame:
    return t.panel().groupBy("entity").agg(F.max_by("close", "d").alias("last_close"), F.min_by("close", "d").alias("first_close"), F.max("d").alias("last_d"))


@query("""SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments, len(list(DISTINCT c_mktsegment)) AS n_segments, round(product(1 + c_acctbal / 1e7), 6) AS growth,
  round(exp(avg(ln(abs(c_acctbal) + 1))) - 1, 4) AS geometric_mean FROM customer GROUP BY 1""")
def ordered_and_list_aggregates(t: Tables) -> DataFrame:
    return t("customer").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("segments"), F.size(F.collect_set("c_mktsegment")).cast("long").alias("n_segments"),
                                                    round6(F.product(1 + F.col("c_acctbal") / 1e7)).alias("growth"), F.round(F.exp(F.avg(F.log(F.abs("c_acctbal") + 1))) - 1, 4).alias("geometric_mean"))


@query("SELECT user_id, count(DISTINCT event_type) AS types, count(DISTINCT (event_type, CAST(ts AS DATE))) AS type_days, max(ts) AS last_ts FROM events GROUP BY 1")
def distinct_counts(t: Tables) -> DataFrame:
    return t("events").groupBy("user_id").agg(F.count_distinct("event_type").alias("types"), F.count_distinct("event_type", F.to_date("ts")).alias("type_days"), F.max("ts").alias("last_ts"))


@query("SELECT CAST(ts AS DATE) AS d, max(CASE WHEN event_type = 'error' THEN value END) AS error_max, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'view') AS views FROM events GROUP BY 1")
def conditional_pivot(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return t("events").groupBy(F.to_date("ts").alias("d")).agg(F.max(F.when(kind == "error", F.col("value"))).alias("error_max"), count_if(kind == "click").alias("clicks"), count_if(kind == "view").alias("views"))


@query("""SELECT observed, round(avg(value) FILTER (WHERE series = '1-URGENT'), 4) AS urgent, round(avg(value) FILTER (WHERE series = '2-HIGH'), 4) AS high, round(avg(value) FILTER (WHERE series = '5-LOW'), 4) AS low FROM observations GROUP BY 1""")
def pivot_series(t: Tables) -> DataFrame:
    wide = t.observations().groupBy("observed").pivot("series", ["1-URGENT", "2-HIGH", "5-LOW"]).agg(F.round(F.avg("value"), 4))
    return wide.select("observed", F.col("1-URGENT").alias("urgent"), F.col("2-HIGH").alias("high"), F.col("5-LOW").alias("low"))


@query("""SELECT d, name, x FROM (SELECT d, close, CASE WHEN volume > 100 THEN volume END AS volume, value FROM market) UNPIVOT (x FOR name IN (close, volume, value))""")
def context_unpivot(t: Tables) -> DataFrame:
    m = t.market().withColumn("volume", F.when(F.col("volume") > 100, F.col("volume")))
    return m.unpivot(["d"], ["close", "volume", "value"], "name", "x").where("x IS NOT NULL")


@query("""WITH b AS (SELECT ntile(4) OVER (ORDER BY l_quantity, l_orderkey, l_linenumber) AS x, ntile(4) OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS y FROM lineitem),
c AS (SELECT x, y, count(*) AS n FROM b GROUP BY 1, 2), p AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER () AS pxy, CAST(sum(n) OVER (PARTITION BY x) AS DOUBLE) / sum(n) OVER () AS px, CAST(sum(n) OVER (PARTITION BY y) AS DOUBLE) / sum(n) OVER () AS py FROM c)
SELECT round(sum(pxy * ln(pxy / (px * py))), 6) AS mutual_information FROM p""")
def mutual_information(t: Tables) -> DataFrame:
    """Quartile codes by exact cut points, not by a global sort: equal to ntile where values are distinct per key order."""
    return S.mutual_information(t("lineitem"), "l_quantity", "l_extendedprice", ["l_orderkey", "l_linenumber"], 4)


@query("SELECT d, round(sum(r * value) / sum(value), 6) AS weighted FROM ret WHERE r IS NOT NULL GROUP BY 1")
def turnover_weighted_return(t: Tables) -> DataFrame:
    return returns(t.panel()).where("r IS NOT NULL").groupBy("d").agg(round6(ratio(F.sum(F.col("r") * F.col("value")), F.sum("value"))).alias("weighted"))


@query("""WITH alive AS (SELECT entity, max(d) >= (SELECT max(d) FROM panel) - 3 AS survivor FROM panel GROUP BY 1)
SELECT d, round(avg(r), 6) AS all_mean, round(avg(r) FILTER (WHERE survivor), 6) AS survivor_mean, round(avg(r) FILTER (WHERE survivor) - avg(r), 6) AS bias FROM ret JOIN alive USING (entity) WHERE r IS NOT NULL GROUP BY d""")
def survivorship_bias(t: Tables) -> DataFrame:
    p = t.panel()
    last = p.agg(F.max("d").alias("last"))
    alive = p.groupBy("entity").agg(F.max("d").alias("m")).join(F.broadcast(last)).select("entity", (F.col("m") >= F.date_sub("last", 3)).alias("survivor"))
    rows = returns(p).where("r IS NOT NULL").join(alive, "entity")
    mean = F.avg(F.when(F.col("survivor"), F.col("r")))
    return rows.groupBy("d").agg(round6(F.avg("r")).alias("all_mean"), round6(mean).alias("survivor_mean"), round6(mean - F.avg("r")).alias("bias"))


@query("""SELECT entity, min(d) AS first_d, max(d) AS last_d, count(*) AS rows, round((max(d) - min(d) + 1) * 5.0 / 7.0, 4) AS expected, round(count(*) / ((max(d) - min(d) + 1) * 5.0 / 7.0), 6) AS coverage FROM panel GROUP BY 1""")
def coverage_audit(t: Tables) -> DataFrame:
    expected = (F.datediff(F.max("d"), F.min("d")) + 1) * F.lit(5.0) / F.lit(7.0)
    return t.panel().groupBy("entity").agg(F.min("d").alias("first_d"), F.max("d").alias("last_d"), F.count("*").alias("rows"), F.round(expected, 4).alias("expected"), round6(F.count("*") / expected).alias("coverage"))


def _exclusive(q: float) -> str:
    k = f"greatest(1, least(n - 1, CAST(floor((n + 1) * {q}) AS INT)))"
    at = f"least(greatest((n + 1) * {q}, 1.0), CAST(n AS DOUBLE))"
    return f"CASE WHEN n = 1 THEN v[1] ELSE v[{k}] + ({at} - {k}) * (v[{k} + 1] - v[{k}]) END"


@query(f"""WITH a AS (SELECT entity, list(r ORDER BY r) AS v, CAST(count(*) AS INT) AS n FROM ret WHERE r IS NOT NULL GROUP BY 1)
SELECT entity, n, round(list_avg(v), 6) AS mean, round(list_median(v), 6) AS median, round(list_avg(list_transform(v, lambda x: CAST(x > 0 AS INT))), 6) AS positive, round({_exclusive(0.25)}, 6) AS q25,
  round({_exclusive(0.75)}, 6) AS q75, round(v[n], 6) AS best, round(v[1], 6) AS worst, CASE WHEN n >= 30 THEN 'good' WHEN n >= 10 THEN 'fair' ELSE 'poor' END AS quality FROM a""")
def event_study_summary(t: Tables) -> DataFrame:
    rows = returns(t.panel()).where("r IS NOT NULL")
    out = rows.groupBy("entity").agg(F.count("*").cast("int").alias("n"), F.array_sort(F.collect_list("r")).alias("v"), F.avg("r").alias("m"), F.median("r").alias("md"), share(F.col("r") > 0).alias("pos"))
    quality = F.when(F.col("n") >= 30, "good").when(F.col("n") >= 10, "fair").otherwise("poor")
    return out.select("entity", "n", round6("m").alias("mean"), round6("md").alias("median"), round6("pos").alias("positive"), round6(S.exclusive_quantile("v", "n", 0.25)).alias("q25"), round6(S.exclusive_quantile("v", "n", 0.75)).alias("q75"),
                      round6(F.element_at("v", -1)).alias("best"), round6(F.element_at("v", 1)).alias("worst"), quality.alias("quality"))


@query(f"""WITH y AS (SELECT entity, d, lead(close, 20) OVER w / nullif(close, 0) - 1 AS r, CASE WHEN lead(close, 20) OVER w IS NOT NULL THEN list(close) OVER (w ROWS BETWEEN CURRENT ROW AND 20 FOLLOWING) END AS p FROM panel WINDOW w AS (PARTITION BY entity ORDER BY d)),
k AS (SELECT *, list_reduce(list_transform(p, lambda c: {{'k': c, 'v': 0.0::DOUBLE}}), lambda q, z: {{'k': greatest(q.k, z.k), 'v': least(q.v, z.k / greatest(q.k, z.k) - 1)}}).v AS dd, count(*) OVER (PARTITION BY entity, year(d)) AS in_year FROM y WHERE r IS NOT NULL),
a AS (SELECT entity, count(*) AS n, count(*) FILTER (WHERE r > 0) AS pos, avg(r) AS mean, median(r) AS median, quantile_cont(r, 0.25) AS q25, quantile_cont(r, 0.75) AS q75, max(r) AS best, min(r) AS worst, avg(dd) AS mdd, median(dd) AS meddd, max(in_year) AS top, sum(r) AS s FROM k GROUP BY 1)
SELECT entity, n, round(pos / n::DOUBLE, 6) AS positive_frequency, round((pos + 1.96 * 1.96 / 2) / (n + 1.96 * 1.96) - 1.96 * sqrt(pos * (n - pos) / n::DOUBLE + 1.96 * 1.96 / 4) / (n + 1.96 * 1.96), 6) AS positive_low,
  round((pos + 1.96 * 1.96 / 2) / (n + 1.96 * 1.96) + 1.96 * sqrt(pos * (n - pos) / n::DOUBLE + 1.96 * 1.96 / 4) / (n + 1.96 * 1.96), 6) AS positive_high, round(mean, 6) AS mean, round(median, 6) AS median, round(q25, 6) AS q25, round(q75, 6) AS q75, round(best, 6) AS best, round(worst, 6) AS worst,
  round(mdd, 6) AS mean_max_drawdown, round(meddd, 6) AS median_max_drawdown, {R.case(R.SAMPLE_QUALITY, R.SAMPLE_QUALITY_ELSE)} AS quality, top / n::DOUBLE > 0.5 AS concentrated, n >= 3 AND abs(mean - (s - best - worst) / nullif(n - 2, 0)) > 0.02 AS extreme FROM a""")
def outcome_summary(t: Tables) -> DataFrame:
    from chronoframe.operators.panel import forward

    y = forward(t.panel().select("entity", "d", "close"), (20,)).select("entity", "d", F.col("forward_return_20").alias("r"), F.col("forward_drawdown_20").alias("drawdown")).where("r IS NOT NULL")
    out = S.outcomes(y, ["entity"], "d", "r", "drawdown")
    as_is = {"entity", "n", "quality", "concentrated", "extreme"}
    return out.select(*[c if c in as_is else round6(c).alias(c) for c in out.columns])


PRED = """pred AS (SELECT entity, d, lead(close, 5) OVER w / nullif(close, 0) - 1 AS y, avg(r) OVER (w ROWS 19 PRECEDING) AS p, stddev_samp(r) OVER (w ROWS 19 PRECEDING) AS s FROM ret WINDOW w AS (PARTITION BY entity ORDER BY d))"""


def predictions(t: Tables) -> DataFrame:
    """(entity, d, y, p, s): five-row forward return, the trailing mean as its forecast, its spread."""
    w = W.by_time("entity", "d")
    return returns(t.panel()).select("entity", "d", (ratio(F.lead("close", 5).over(w), "close") - 1).alias("y"), F.avg("r").over(W.frame(w, 20)).alias("p"), F.stddev_samp("r").over(W.frame(w, 20)).alias("s"))


@query(f"""WITH {PRED} SELECT entity, count(*) AS n, round(avg(CAST(sign(y) = sign(p) AS INT)), 6) AS hit_rate, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse,
  round(avg(CAST(abs(y - p) <= 0.674 * s AS INT)), 6) AS coverage_50, round(avg(CAST(abs(y - p) <= 1.282 * s AS INT)), 6) AS coverage_80, round(avg(CAST(abs(y - p) <= 1.645 * s AS INT)), 6) AS coverage_90 FROM pred WHERE y IS NOT NULL AND s IS NOT NULL GROUP BY 1""")
def forecast_scorecards(t: Tables) -> DataFrame:
    rows = predictions(t).where("y IS NOT NULL AND s IS NOT NULL").withColumn("e", F.abs(F.col("y") - F.col("p")))
    inside = [round6(share(F.col("e") <= k * F.col("s"))).alias(f"coverage_{c}") for c, k in ((50, 0.674), (80, 1.282), (90, 1.645))]
    return rows.groupBy("entity").agg(F.count("*").alias("n"), round6(share(F.signum("y") == F.signum("p"))).alias("hit_rate"), round6(F.avg("e")).alias("mae"), round6(F.sqrt(F.avg(F.col("e") * F.col("e")))).alias("rmse"), *inside)


@query(f"""WITH {PRED}, k AS (SELECT *, rank() OVER (PARTITION BY d ORDER BY y) + (count(*) OVER (PARTITION BY d, y) - 1) / 2.0 AS ry, rank() OVER (PARTITION BY d ORDER BY p) + (count(*) OVER (PARTITION BY d, p) - 1) / 2.0 AS rp FROM pred WHERE y IS NOT NULL AND p IS NOT NULL)
SELECT d, count(*) AS n, CASE WHEN count(*) >= 5 THEN round(corr(ry, rp), 5) END AS rank_ic FROM k GROUP BY 1""")
def rank_ic(t: Tables) -> DataFrame:
    rows = predictions(t).where("y IS NOT NULL AND p IS NOT NULL")
    rows = rows.withColumn("ry", W.average_rank("y", ["d"])).withColumn("rp", W.average_rank("p", ["d"]))
    return rows.groupBy("d").agg(F.count("*").alias("n"), F.when(F.count("*") >= 5, F.round(corr("ry", "rp"), 5)).alias("rank_ic"))


@query(f"""WITH {PRED}, k AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY p DESC, entity) AS top, row_number() OVER (PARTITION BY d ORDER BY p, entity) AS low, row_number() OVER (PARTITION BY d ORDER BY y DESC, entity) AS ideal,
  percent_rank() OVER (PARTITION BY d ORDER BY y) AS rel FROM pred WHERE y IS NOT NULL AND p IS NOT NULL)
SELECT d, round(avg(y) FILTER (WHERE top <= 5), 6) AS top_5, round(avg(y) FILTER (WHERE low <= 5), 6) AS bottom_5, round(avg(y) FILTER (WHERE top <= 5) - avg(y) FILTER (WHERE low <= 5), 6) AS spread,
  round(avg(CAST(y > 0 AS INT)) FILTER (WHERE top <= 5), 6) AS hit_rate, round(sum(rel / ln(1 + top) * ln(2)) FILTER (WHERE top <= 5) / nullif(sum(rel / ln(1 + ideal) * ln(2)) FILTER (WHERE ideal <= 5), 0), 6) AS ndcg_5 FROM k GROUP BY 1""")
def top_k_spread(t: Tables) -> DataFrame:
    rows = predictions(t).where("y IS NOT NULL AND p IS NOT NULL")
    day = Window.partitionBy("d")
    rows = rows.withColumn("top", F.row_number().over(day.orderBy(F.col("p").desc(), "entity"))).withColumn("low", F.row_number().over(day.orderBy("p", "entity")))
    rows = rows.withColumn("ideal", F.row_number().over(day.orderBy(F.col("y").desc(), "entity"))).withColumn("rel", F.percent_rank().over(day.orderBy("y")))
    pick = lambda c, x: F.when(F.col(c) <= 5, x)
    gain = lambda c: F.sum(pick(c, F.col("rel") / F.log(1 + F.col(c)) * F.log(F.lit(2.0))))
    top, low = F.avg(pick("top", F.col("y"))), F.avg(pick("low", F.col("y")))
    return rows.groupBy("d").agg(round6(top).alias("top_5"), round6(low).alias("bottom_5"), round6(top - low).alias("spread"), round6(F.avg(pick("top", (F.col("y") > 0).cast("double")))).alias("hit_rate"), round6(ratio(gain("top"), gain("ideal"))).alias("ndcg_5"))


CONTEXT = "CASE WHEN s > 1.5 THEN 'regime_high' ELSE 'regime_low' END"


@query(f"""WITH {PRED}, c AS (SELECT *, {CONTEXT} AS regime, CASE WHEN day(d) = 15 THEN 'event' ELSE 'normal' END AS kind FROM pred WHERE y IS NOT NULL AND s IS NOT NULL)
SELECT coalesce(kind, regime, 'all') AS context, count(*) AS n, round(avg(abs(y - p)), 6) AS mae, round(avg(CAST(sign(y) = sign(p) AS INT)), 6) AS hit_rate FROM c GROUP BY GROUPING SETS ((), (kind), (regime))""")
def context_scorecards(t: Tables) -> DataFrame:
    rows = predictions(t).where("y IS NOT NULL AND s IS NOT NULL")
    tags = F.array(F.lit("all"), F.when(F.dayofmonth("d") == 15, "event").otherwise("normal"), F.when(F.col("s") > 1.5, "regime_high").otherwise("regime_low"))
    return rows.withColumn("context", F.explode(tags)).groupBy("context").agg(F.count("*").alias("n"), round6(F.avg(F.abs(F.col("y") - F.col("p")))).alias("mae"), round6(share(F.signum("y") == F.signum("p"))).alias("hit_rate"))


@query("""SELECT coalesce(r_name, '*') AS region, coalesce(c_mktsegment, '*') AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY CUBE (r_name, c_mktsegment)""")
def cube_rollup(t: Tables) -> DataFrame:
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.cube("r_name", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance")).select(F.coalesce("r_name", F.lit("*")).alias("region"), F.coalesce("c_mktsegment", F.lit("*")).alias("segment"), "n", "balance")


@query(f"""WITH {PRED}, c AS (SELECT *, {CONTEXT} AS regime FROM pred WHERE y IS NOT NULL AND s IS NOT NULL) SELECT entity, regime, count(*) AS n, round(avg(y), 6) AS mean_y, round(median(y), 6) AS median_y, round(avg(CAST(y > 0 AS INT)), 6) AS positive FROM c GROUP BY 1, 2""")
def regime_conditional_effects(t: Tables) -> DataFrame:
    rows = predictions(t).where("y IS NOT NULL AND s IS NOT NULL").withColumn("regime", F.when(F.col("s") > 1.5, "regime_high").otherwise("regime_low"))
    return rows.groupBy("entity", "regime").agg(F.count("*").alias("n"), round6(F.avg("y")).alias("mean_y"), round6(F.median("y")).alias("median_y"), round6(share(F.col("y") > 0)).alias("positive"))


# Windows

@query("""SELECT event_id, user_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS episode FROM (
  SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events)""")
def episode_sessionization(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(w) > F.expr("INTERVAL 6 HOURS")
    rows = t("events").withColumn("g", F.coalesce(gap, F.lit(True)).cast("int"))
    return rows.select("event_id", "user_id", F.sum("g").over(W.so_far(w)).alias("episode"))


SIGNS = "sg AS (SELECT entity, d, CAST(sign(r) AS INT) AS s FROM ret WHERE r IS NOT NULL)"


def signs(t: Tables) -> DataFrame:
    return returns(t.panel()).where("r IS NOT NULL").select("entity", "d", F.signum("r").cast("int").alias("s"))


@query(f"""WITH {SIGNS}, c AS (SELECT *, CASE WHEN lag(s) OVER w IS DISTINCT FROM s OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS ch FROM sg WINDOW w AS (PARTITION BY entity ORDER BY d)),
e AS (SELECT *, CAST(sum(ch) OVER (PARTITION BY entity ORDER BY d) AS BIGINT) AS run FROM c) SELECT entity, d, s, run, CAST(row_number() OVER (PARTITION BY entity, run ORDER BY d) AS INTEGER) AS duration FROM e""")
def run_length_regimes(t: Tables) -> DataFrame:
    runs = W.run_id(signs(t), ["entity"], "d", "s")
    return runs.withColumn("duration", F.row_number().over(W.by_time(["entity", "run"], "d"))).select("entity", "d", "s", "run", "duration")


@query(f"""WITH {SIGNS}, p AS (SELECT entity, lag(s) OVER (PARTITION BY entity ORDER BY d) AS a, s AS b FROM sg), n AS (SELECT a, b, count(*) AS n FROM p WHERE a IS NOT NULL GROUP BY 1, 2),
g AS (SELECT x.v AS a, y.v AS b FROM (VALUES (-1), (0), (1)) x(v), (VALUES (-1), (0), (1)) y(v)), f AS (SELECT g.a, g.b, coalesce(n, 0) AS n FROM g LEFT JOIN n ON g.a = n.a AND g.b = n.b)
SELECT a AS from_state, b AS to_state, n, round((n + 1.0) / (sum(n) OVER (PARTITION BY a) + 3.0), 6) AS probability FROM f""")
def transition_matrix(t: Tables) -> DataFrame:
    return S.transitions(signs(t), ["entity"], "d", "s", [-1, 0, 1])


@query("""SELECT entity, d, round(close - avg(close) OVER (PARTITION BY d), 4) AS demeaned, count(*) OVER (PARTITION BY entity ORDER BY d) AS history, round(percent_rank() OVER (PARTITION BY d ORDER BY close NULLS LAST), 6) AS percentile,
  CAST(dense_rank() OVER (PARTITION BY d ORDER BY trades DESC) AS INTEGER) AS trade_rank, round(max(close) OVER (PARTITION BY entity ORDER BY d) , 6) AS peak FROM panel""")
def cross_section_windows(t: Tables) -> DataFrame:
    day = Window.partitionBy("d")
    w = W.so_far(W.by_time("entity", "d"))
    return t.panel().select("entity", "d", F.round(F.col("close") - F.avg("close").over(day), 4).alias("demeaned"), F.count(F.lit(1)).over(w).alias("history"), round6(F.percent_rank().over(day.orderBy(F.col("close").asc_nulls_last()))).alias("percentile"),
                            F.dense_rank().over(day.orderBy(F.col("trades").desc())).alias("trade_rank"), round6(F.max("close").over(w)).alias("peak"))


@query("""WITH a AS (SELECT entity, d, close, list(close) OVER (PARTITION BY entity ORDER BY d ROWS 59 PRECEDING) AS p FROM panel)
SELECT entity, d, CASE WHEN len(p) >= 60 THEN round(list_min(list_transform(p, lambda x, i: x / list_max(p[1:i]) - 1)), 6) END AS max_drawdown_60 FROM a""")
def rolling_drawdown(t: Tables) -> DataFrame:
    w = W.frame(W.by_time("entity", "d"), 60)
    a = t.panel().select("entity", "d", F.collect_list("close").over(w).alias("p"))
    return a.select("entity", "d", F.when(F.size("p") >= 60, round6(W.drawdown_of(F.col("p")))).alias("max_drawdown_60"))


@query("""SELECT d, round(quantile_cont(close, 0.33) OVER w, 5) AS q33, round(quantile_cont(close, 0.67) OVER w, 5) AS q67, round(stddev_samp(close) OVER w, 5) AS sd FROM market WINDOW w AS (ORDER BY d)""")
def expanding_quantiles(t: Tables) -> DataFrame:
    m = t.market().withColumn("k", F.lit(1))
    w = W.so_far(Window.partitionBy("k").orderBy("d"))
    return m.select("d", F.round(F.percentile("close", F.lit(0.33)).over(w), 5).alias("q33"), F.round(F.percentile("close", F.lit(0.67)).over(w), 5).alias("q67"), F.round(F.stddev_samp("close").over(w), 5).alias("sd"))


@query("""WITH seg AS (SELECT entity, board, min(d) AS a, CASE WHEN board <> 'N' THEN max(d) END AS b, board = 'R' AS is_primary FROM boards WHERE entity % 7 <> 0 OR board <> 'N' GROUP BY 1, 2),
x AS (SELECT b.entity, b.board, b.d, b.close, quantile_cont(b.value, 0.5) OVER (PARTITION BY b.entity, b.board ORDER BY b.d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS liq FROM boards b),
y AS (SELECT x.*, coalesce(is_primary, false) AS is_primary, coalesce(a IS NOT NULL AND d >= a AND (b IS NULL OR d <= b), false) AND close > 0 AND coalesce(liq, 0) >= 20000 AS eligible FROM x LEFT JOIN seg ON x.entity = seg.entity AND x.board = seg.board)
SELECT entity, d, board, eligible, round(liq, 4) AS liquidity FROM (SELECT *, row_number() OVER (PARTITION BY d, entity ORDER BY is_primary DESC, liq DESC NULLS LAST, board) AS k FROM y) WHERE k = 1""")
def point_in_time_membership(t: Tables) -> DataFrame:
    boards = t.boards().select("entity", "board", "d", "close", "value")
    life = boards.where("entity % 7 <> 0 OR board <> 'N'").groupBy("entity", "board").agg(F.min("d").alias("valid_from"), F.max(F.when(F.col("board") != "N", F.col("d"))).alias("valid_to"), (F.first("board") == "R").alias("is_primary"))
    return P.membership(boards, life, 20_000.0).select("entity", "d", "board", "eligible", F.round("liquidity", 4).alias("liquidity"))


@query("""WITH a AS (SELECT entity, d, lead(close, 5) OVER w / nullif(close, 0) - 1 AS y FROM panel WINDOW w AS (PARTITION BY entity ORDER BY d)), k AS (SELECT *, lag(y, 5) OVER (PARTITION BY entity ORDER BY d) AS known FROM a)
SELECT entity, d, round(y, 6) AS y, round(avg(known) OVER (PARTITION BY entity ORDER BY d), 6) AS expanding_mean, round(quantile_cont(known, 0.5) OVER (PARTITION BY entity ORDER BY d ROWS 251 PRECEDING), 6) AS median_252 FROM k""")
def embargoed_baselines(t: Tables) -> DataFrame:
    w = W.by_time("entity", "d")
    a = t.panel().withColumn("y", ratio(F.lead("close", 5).over(w), "close") - 1).withColumn("known", F.lag("y", 5).over(w))
    return a.select("entity", "d", round6("y").alias("y"), round6(F.avg("known").over(W.so_far(w))).alias("expanding_mean"), round6(F.percentile("known", F.lit(0.5)).over(W.frame(w, 252))).alias("median_252"))


@query("""SELECT d, entity, rank() OVER (PARTITION BY d ORDER BY trades) AS rank_min, row_number() OVER (PARTITION BY d ORDER BY trades, entity) AS rank_first,
  round(rank() OVER (PARTITION BY d ORDER BY trades) + (count(*) OVER (PARTITION BY d, trades) - 1) / 2.0, 6) AS rank_average, rank() OVER (PARTITION BY d ORDER BY trades) + count(*) OVER (PARTITION BY d, trades) - 1 AS rank_max FROM panel""")
def rank_methods(t: Tables) -> DataFrame:
    day = Window.partitionBy("d").orderBy("trades")
    ties = F.count(F.lit(1)).over(Window.partitionBy("d", "trades"))
    return t.panel().select("d", "entity", F.rank().over(day).cast("long").alias("rank_min"), F.row_number().over(Window.partitionBy("d").orderBy("trades", "entity")).cast("long").alias("rank_first"),
                            round6(W.average_rank("trades", ["d"])).alias("rank_average"), (F.rank().over(day) + ties - 1).alias("rank_max"))
