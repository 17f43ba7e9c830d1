"""Join, as-of, interval, set and top-k queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions.expr import ratio, round6
from chronoframe.operators import joins as J
from chronoframe.operators import rules as R
from chronoframe.operators import windows as W
from chronoframe.operators.panel import returns
from chronoframe.plans.bindings import Tables
from chronoframe.queries.registry import query

OBS = "SELECT series, available, value, vintage FROM (SELECT *, row_number() OVER (PARTITION BY series, available ORDER BY vintage DESC) AS n FROM observations) WHERE n = 1"


def _obs(t: Tables) -> DataFrame:
    return W.latest(t.observations(), ["series", "available"], [F.col("vintage").desc()]).select("series", "available", "value", "vintage")


def _grid(t: Tables) -> DataFrame:
    return t.market().select("d").join(F.broadcast(t.observations().select("series").distinct()))


@query(f"""WITH o AS ({OBS}), g AS (SELECT d, series FROM (SELECT DISTINCT d FROM market) CROSS JOIN (SELECT DISTINCT series FROM observations))
SELECT g.d, g.series, o.available, o.value, o.vintage FROM g ASOF LEFT JOIN o ON g.series = o.series AND g.d >= o.available""")
def asof_backward(t: Tables) -> DataFrame:
    return J.asof(_grid(t), _obs(t), ["series"], "d", "available", ["value", "vintage"], bucket="month").select("d", "series", F.col("asof_available").alias("available"), "value", "vintage")


@query(f"""WITH o AS ({OBS}), g AS (SELECT d, series FROM (SELECT DISTINCT d FROM market) CROSS JOIN (SELECT DISTINCT series FROM observations))
SELECT g.d, g.series, o.available, o.value FROM g ASOF JOIN o ON g.series = o.series AND g.d >= o.available""")
def asof_inner(t: Tables) -> DataFrame:
    return J.asof(_grid(t), _obs(t), ["series"], "d", "available", ["value"], inner=True, bucket="quarter").select("d", "series", F.col("asof_available").alias("available"), "value")


@query("""WITH o AS (SELECT l_suppkey AS entity, o_orderkey, max(CAST(o_orderdate AS DATE)) AS published FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)
SELECT o.entity, o.o_orderkey, o.published, p.d AS first_session, p.close FROM o ASOF LEFT JOIN panel p ON o.entity = p.entity AND o.published <= p.d""")
def asof_forward_first_price(t: Tables) -> DataFrame:
    o = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("l_suppkey").alias("entity"), "o_orderkey").agg(F.max(F.to_date("o_orderdate")).alias("published"))
    return J.asof(o, t.panel().select("entity", "d", "close"), ["entity"], "published", "d", ["close"], forward=True, bucket="year").select("entity", "o_orderkey", "published", F.col("asof_d").alias("first_session"), "close")


@query("""SELECT series, observed, available, vintage, value FROM (SELECT *, row_number() OVER (PARTITION BY series, observed ORDER BY available DESC, vintage DESC) AS n
FROM observations WHERE available <= DATE '1998-06-30') WHERE n = 1""")
def latest_vintage(t: Tables) -> DataFrame:
    known = t.observations().where(F.col("available") <= F.lit("1998-06-30").cast("date"))
    return W.latest(known, ["series", "observed"], [F.col("available").desc(), F.col("vintage").desc()]).select("series", "observed", "available", "vintage", "value")


@query("""WITH q AS (SELECT DISTINCT CAST(date_trunc('quarter', d) AS DATE) AS q FROM market)
SELECT q.q AS quarter, s.issuer, s.period, s.profit, s.equity FROM q JOIN LATERAL (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY issuer ORDER BY period DESC) AS n FROM statements WHERE available <= q.q) WHERE n = 1) s ON true""")
def lateral_latest_revision(t: Tables) -> DataFrame:
    q = t.market().select(F.to_date(F.date_trunc("quarter", "d")).alias("quarter")).distinct()
    s = t.statements()
    grid = q.join(F.broadcast(s.select("issuer").distinct()))
    return J.asof(grid, s, ["issuer"], "quarter", "available", ["period", "profit", "equity"], inner=True).select("quarter", "issuer", "period", "profit", "equity")


@query("""WITH s AS (SELECT *, available AS valid_from, lead(available) OVER (PARTITION BY issuer ORDER BY available) AS valid_to FROM statements)
SELECT m.d, s.issuer, s.period, s.profit FROM market m JOIN s ON m.d >= s.valid_from AND (s.valid_to IS NULL OR m.d < s.valid_to)""")
def locf_interval_states(t: Tables) -> DataFrame:
    """Each day's state by expanding intervals over the sessions they hold: an equi join, no theta join."""
    s = J.locf_intervals(t.statements(), ["issuer"], "available")
    last = t.market().agg(F.max("d").alias("last"))
    days = s.join(F.broadcast(last)).where(F.col("valid_from") <= F.col("last"))
    end = F.least(F.coalesce(F.date_sub("valid_to", 1), F.col("last")), F.col("last"))
    return days.withColumn("d", F.explode(F.sequence("valid_from", end))).join(t.market().select("d"), "d").select("d", "issuer", "period", "profit")


@query("SELECT r.entity, r.d, round(r.r, 6) AS r, round(m.r, 6) AS market_r FROM ret r JOIN mret m USING (d) WHERE r.r IS NOT NULL")
def equi_join_market(t: Tables) -> DataFrame:
    m = returns(t.market().withColumn("entity", F.lit(0))).select("d", F.col("r").alias("market_r"))
    return returns(t.panel()).where("r IS NOT NULL").join(m, "d").select("entity", "d", round6("r").alias("r"), round6("market_r").alias("market_r"))


@query("""SELECT c.c_custkey, c.c_mktsegment, count(o.o_orderkey) AS orders, round(coalesce(sum(o.o_totalprice), 0.0), 2) AS spent, n.n_name, r.r_name
FROM customer c LEFT JOIN orders o ON c_custkey = o_custkey LEFT JOIN nation n ON c_nationkey = n_nationkey LEFT JOIN region r ON n_regionkey = r_regionkey GROUP BY ALL""")
def left_join_enrichment(t: Tables) -> DataFrame:
    spent = t("orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("orders"), F.sum("o_totalprice").alias("s"))
    rows = t("customer").join(spent, F.col("c_custkey") == F.col("o_custkey"), "left")
    rows = rows.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return rows.select("c_custkey", "c_mktsegment", F.coalesce("orders", F.lit(0)).cast("long").alias("orders"), F.round(F.coalesce("s", F.lit(0.0)), 2).alias("spent"), "n_name", "r_name")


@query("SELECT o_orderkey, o_custkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE l_orderkey IS NULL")
def orphan_anti(t: Tables) -> DataFrame:
    return t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


@query("""WITH g AS (SELECT entity, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT entity, min(d) AS lo, max(d) AS hi FROM panel GROUP BY entity))
SELECT entity, d FROM g WHERE NOT EXISTS (SELECT 1 FROM panel p WHERE p.entity = g.entity AND p.d = g.d)""")
def not_exists_grid(t: Tables) -> DataFrame:
    span = t.panel().groupBy("entity").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    return J.missing_from_grid(span.select("entity", F.explode(F.sequence("lo", "hi")).alias("d")), t.panel(), ["entity", "d"])


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31') AS active_1996 FROM customer c")
def exists_projected(t: Tables) -> DataFrame:
    spark, c, o = t.spark, t("customer"), t("orders")
    return spark.sql("SELECT c_custkey, EXISTS (SELECT 1 FROM {o} o WHERE o.o_custkey = c.c_custkey AND o.o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31') AS active_1996 FROM {c} c", c=c, o=o)


@query("""WITH seg AS (SELECT entity, board, min(d) AS a, max(d) AS b FROM boards GROUP BY 1, 2)
SELECT x.entity, x.board AS board_a, y.board AS board_b, greatest(x.a, y.a) AS from_d, least(x.b, y.b) AS to_d FROM seg x JOIN seg y ON x.entity = y.entity AND x.board < y.board AND x.a <= y.b AND y.a <= x.b""")
def segment_overlap(t: Tables) -> DataFrame:
    seg = t.boards().groupBy("entity", "board").agg(F.min("d").alias("a"), F.max("d").alias("b"))
    x, y = seg.alias("x"), seg.alias("y")
    on = (F.col("x.entity") == F.col("y.entity")) & (F.col("x.board") < F.col("y.board")) & (F.col("x.a") <= F.col("y.b")) & (F.col("y.a") <= F.col("x.b"))
    return x.join(y, on).select("x.entity", F.col("x.board").alias("board_a"), F.col("y.board").alias("board_b"), F.greatest("x.a", "y.a").alias("from_d"), F.least("x.b", "y.b").alias("to_d"))


@query(f"""WITH o AS ({OBS}) SELECT m.d, (SELECT o.value FROM o WHERE o.series = '1-URGENT' AND o.available <= m.d ORDER BY o.available DESC LIMIT 1) AS urgent FROM market m""")
def correlated_latest_scalar(t: Tables) -> DataFrame:
    one = t.market().select("d").withColumn("series", F.lit("1-URGENT"))
    return J.asof(one, _obs(t), ["series"], "d", "available", ["value"], bucket="quarter").select("d", F.col("value").alias("urgent"))


@query("""SELECT d, name, item AS value FROM (SELECT d, close, value, volume FROM market) m CROSS JOIN LATERAL (VALUES ('close', close), ('log_value', round(ln(value), 6)), ('price_per_volume', round(value / volume, 6))) v(name, item)""")
def lateral_values(t: Tables) -> DataFrame:
    items = {"close": F.col("close"), "log_value": round6(F.log("value")), "price_per_volume": round6(F.col("value") / F.col("volume"))}
    parts = F.array(*[F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in items.items()])
    return t.market().select("d", F.inline(parts))


RATIOS = (0.1, 0.2, 0.25, 0.5, 2.0, 4.0, 5.0, 10.0)


@query(f"""WITH x AS (SELECT p_partkey, p_size, p_retailprice, p_size / 5.0 AS observed FROM part WHERE p_size > 0)
SELECT p_partkey, round(observed, 6) AS observed, ratio AS nearest, round(abs(ln(observed) - ln(ratio)), 6) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(ln(observed) - ln(ratio)), ratio) AS n FROM x CROSS JOIN (SELECT unnest([{', '.join(f'CAST({r} AS DOUBLE)' for r in RATIOS)}]) AS ratio)) WHERE n = 1""")
def nearest_ratio(t: Tables) -> DataFrame:
    x = t("part").where("p_size > 0").select("p_partkey", (F.col("p_size") / 5.0).alias("observed"))
    distance = lambda r: F.abs(F.log("observed") - F.log(F.lit(r)))
    best = F.array_min(F.array(*[F.struct(distance(r).alias("distance"), F.lit(r).alias("nearest")) for r in RATIOS]))
    return x.withColumn("b", best).select("p_partkey", round6("observed").alias("observed"), "b.nearest", round6("b.distance").alias("distance"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority IN (SELECT unnest(['1-URGENT', '2-HIGH']))")
def semi_join_list(t: Tables) -> DataFrame:
    return t("orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_totalprice")


@query("""WITH a AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_suppkey AS k, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
c AS (SELECT s_suppkey AS k, s_acctbal FROM supplier WHERE s_acctbal > 0) SELECT k, n, q, s_acctbal FROM a JOIN b USING (k) JOIN c USING (k)""")
def common_sample(t: Tables) -> DataFrame:
    li = t("lineitem")
    a = li.where("l_returnflag = 'A'").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("n"))
    b = li.where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("k")).agg(F.sum("l_quantity").alias("q"))
    c = t("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("k"), "s_acctbal")
    return J.common_sample([a, b, c], ["k"])


@query("""SELECT d, max(CASE WHEN board = 'A' THEN c END) AS a, max(CASE WHEN board = 'N' THEN c END) AS n, max(CASE WHEN board = 'R' THEN c END) AS r, round(max(CASE WHEN board = 'A' THEN c END) - max(CASE WHEN board = 'R' THEN c END), 6) AS spread
FROM (SELECT d, board, round(avg(close), 8) AS c FROM boards GROUP BY 1, 2) GROUP BY d""")
def triple_self_join_as_pivot(t: Tables) -> DataFrame:
    by = t.boards().groupBy("d", "board").agg(F.round(F.avg("close"), 8).alias("c"))
    wide = by.groupBy("d").pivot("board", ["A", "N", "R"]).agg(F.first("c"))
    return wide.select("d", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"), round6(F.col("A") - F.col("R")).alias("spread"))


@query("""SELECT x.d, x.entity AS ordinary, y.entity AS preferred, round(x.close / nullif(y.close, 0) - 1, 6) AS spread FROM panel x JOIN panel y ON x.d = y.d AND y.entity = x.entity + 1 WHERE x.entity % 2 = 1""")
def pair_spread(t: Tables) -> DataFrame:
    x = t.panel().where("entity % 2 = 1").select("d", F.col("entity").alias("ordinary"), F.col("close").alias("a"), (F.col("entity") + 1).alias("preferred"))
    y = t.panel().select("d", F.col("entity").alias("preferred"), F.col("close").alias("b"))
    return x.join(y, ["d", "preferred"]).select("d", "ordinary", "preferred", round6(ratio("a", "b") - 1).alias("spread"))


@query("""WITH ev AS (SELECT event_id, user_id, CAST(value AS INT) AS code, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'error'), act AS (SELECT event_id AS act_id, user_id AS u, CAST(value AS INT) AS c, CAST(ts AS DATE) AS ad FROM events WHERE event_type = 'purchase')
SELECT DISTINCT event_id, act_id, d, ad FROM ev JOIN act ON (ev.user_id = act.u OR ev.code = act.c) AND ad BETWEEN d - 1 AND d + 1""")
def or_key_evidence_link(t: Tables) -> DataFrame:
    e = t("events")
    ev = e.where("event_type = 'error'").select("event_id", "user_id", F.bround("value").cast("int").alias("code"), F.to_date("ts").alias("d"))
    act = e.where("event_type = 'purchase'").select(F.col("event_id").alias("act_id"), F.col("user_id").alias("u"), F.bround("value").cast("int").alias("c"), F.to_date("ts").alias("ad"))
    near = F.col("ad").between(F.date_sub("d", 1), F.date_add("d", 1))
    return J.any_key(ev, act, [("user_id", "u"), ("code", "c")], near).select("event_id", "act_id", "d", "ad").distinct()


@query("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")
def order_limit(t: Tables) -> DataFrame:
    return t("orders").select("o_orderkey", "o_totalprice", "o_orderdate").orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey").limit(25)


@query("SELECT entity, d, round(r, 6) AS r FROM ret WHERE r IS NOT NULL ORDER BY abs(r) DESC, entity, d LIMIT 10")
def largest_moves(t: Tables) -> DataFrame:
    return returns(t.panel()).where("r IS NOT NULL").orderBy(F.abs("r").desc(), "entity", "d").limit(10).select("entity", "d", round6("r").alias("r"))


@query("SELECT d, entity, value, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY d ORDER BY value DESC, entity) AS INTEGER) AS rank FROM panel) WHERE rank <= 3")
def top_k_per_group(t: Tables) -> DataFrame:
    return W.top_k(t.panel(), ["d"], [F.col("value").desc(), F.col("entity")], 3).select("d", "entity", "value", "rank")


@query("SELECT 'customer' AS kind, c_nationkey AS k, c_acctbal AS bal FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier")
def union_all(t: Tables) -> DataFrame:
    a = t("customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("bal"))
    return a.unionByName(t("supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("bal")))


@query("""SELECT 'both' AS side, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL
SELECT 'customer_only', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)""")
def set_operations(t: Tables) -> DataFrame:
    a, b = t("customer").select(F.col("c_nationkey").alias("k")), t("supplier").select(F.col("s_nationkey").alias("k"))
    return a.intersect(b).select(F.lit("both").alias("side"), "k").unionByName(a.subtract(b).select(F.lit("customer_only").alias("side"), "k"))


MONTH_TOP = """WITH m AS (SELECT CAST(date_trunc('month', d) AS DATE) AS m, entity, sum(value) AS v FROM panel GROUP BY 1, 2),
s AS (SELECT m, list(entity) AS members FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY v DESC, entity) AS n FROM m) WHERE n <= 20 GROUP BY m)"""


@query(MONTH_TOP + """ SELECT m, CASE WHEN prev IS NOT NULL THEN round(len(list_intersect(members, prev)) / len(list_distinct(list_concat(members, prev))), 6) END AS jaccard, CAST(len(members) AS INTEGER) AS size
FROM (SELECT *, lag(members) OVER (ORDER BY m) AS prev FROM s)""")
def membership_turnover(t: Tables) -> DataFrame:
    m = t.panel().groupBy(F.to_date(F.date_trunc("month", "d")).alias("m"), "entity").agg(F.sum("value").alias("v"))
    s = W.top_k(m, ["m"], [F.col("v").desc(), F.col("entity")], 20).groupBy("m").agg(F.collect_set("entity").alias("members"))
    prev = F.lag("members").over(Window.orderBy("m"))
    return s.select("m", round6(F.size(F.array_intersect("members", prev)).cast("double") / F.nullif(F.size(F.array_union("members", prev)), F.lit(0))).alias("jaccard"), F.size("members").alias("size"))


@query("""SELECT entity, d, board, value FROM (SELECT *, row_number() OVER (PARTITION BY entity, d ORDER BY CASE board WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, value DESC) AS n FROM boards) WHERE n = 1""")
def deduplicate_by_priority(t: Tables) -> DataFrame:
    order = F.when(F.col("board") == "N", 0).when(F.col("board") == "A", 1).otherwise(2)
    return W.latest(t.boards(), ["entity", "d"], [order, F.col("value").desc()]).select("entity", "d", "board", "value")


STATS = """s AS (SELECT entity, round(avg(r), 8) AS gain, round(stddev_samp(r), 8) AS risk FROM ret GROUP BY entity)"""


def entity_stats(t: Tables) -> DataFrame:
    return returns(t.panel()).groupBy("entity").agg(F.round(F.avg("r"), 8).alias("gain"), F.round(F.stddev_samp("r"), 8).alias("risk"))


@query(f"""WITH {STATS} SELECT entity, gain, risk, EXISTS (SELECT 1 FROM s o WHERE o.gain >= s.gain AND o.risk <= s.risk AND (o.gain > s.gain OR o.risk < s.risk)) AS dominated FROM s""")
def pareto_dominance(t: Tables) -> DataFrame:
    """Dominated iff a row before it in (gain desc, risk) order has no more risk: one sort, no pairs."""
    s = entity_stats(t)
    w = Window.orderBy(F.col("gain").desc(), "risk")
    ties = Window.partitionBy("gain")
    best = F.min("risk").over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("before", best).withColumn("peer", F.min("risk").over(ties))
    first = F.first("before").over(Window.partitionBy("gain").orderBy("risk").rowsBetween(Window.unboundedPreceding, 0))
    above = F.coalesce(first <= F.col("risk"), F.lit(False))
    return s.select("entity", "gain", "risk", (above | (F.col("peer") < F.col("risk"))).alias("dominated"))


@query(f"""WITH {STATS}, m AS (SELECT median(gain) AS g, median(risk) AS k FROM s), x AS (SELECT entity, gain >= g AS high, risk <= k AS calm FROM s, m)
SELECT entity, {R.case(R.QUADRANT, R.QUADRANT_ELSE)} AS quadrant FROM x""")
def quadrant_labels(t: Tables) -> DataFrame:
    s = entity_stats(t)
    s = s.join(F.broadcast(s.agg(F.median("gain").alias("g"), F.median("risk").alias("k"))))
    return s.withColumns({"high": F.col("gain") >= F.col("g"), "calm": F.col("risk") <= F.col("k")}).select("entity", R.label(R.QUADRANT, R.QUADRANT_ELSE).alias("quadrant"))


@query(None)
def greedy_spacing_top_k(t: Tables) -> DataFrame:
    """Five nearest days by |return - last return| an entity, chosen days at least 20 rows apart."""
    from chronoframe.operators.analogs import spaced_top_k

    w = W.by_time("entity", "d")
    rows = returns(t.panel()).withColumn("pos", F.row_number().over(w))
    last = rows.groupBy("entity").agg(F.max_by("r", "pos").alias("target"))
    rows = rows.join(last, "entity").where("r IS NOT NULL").select("entity", "pos", F.round(F.abs(F.col("r") - F.col("target")), 9).alias("distance"))
    return spaced_top_k(rows, ["entity"], "distance", "pos", 20, 5)

