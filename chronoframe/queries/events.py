"""Event, news, lifecycle, decision and scalar-surface queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions.expr import finite, key_hash, ratio, round6
from chronoframe.operators import events as E
from chronoframe.operators import rules as R
from chronoframe.operators import windows as W
from chronoframe.operators.joins import asof
from chronoframe.operators.panel import returns
from chronoframe.plans.bindings import Tables
from chronoframe.queries.registry import query

MIL = "ev AS (SELECT o_orderkey AS event_id, o_custkey % 100 + 1 AS entity, CAST(o_orderdate AS DATE) AS event_d FROM orders WHERE o_orderpriority = '1-URGENT')"


def urgent(t: Tables) -> DataFrame:
    return t("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("event_id"), (F.col("o_custkey") % 100 + 1).alias("entity"), F.to_date("o_orderdate").alias("event_d"))


REACTION_HORIZONS = (0, 1, 3, 5, 20, 60)


@query(f"""WITH {MIL}, o AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY d) AS n FROM panel), g AS (SELECT entity, list(close ORDER BY d) AS cs, list(d ORDER BY d) AS ds FROM o GROUP BY 1),
e AS (SELECT *, count(*) OVER (PARTITION BY entity, event_d) AS same_day, day(event_d) = 15 AS dividend_day FROM ev), a AS (SELECT event_id, e.entity, same_day, dividend_day, o.d AS anchor, n, close FROM e ASOF JOIN o ON e.entity = o.entity AND e.event_d <= o.d),
p AS (SELECT a.*, h AS horizon, ds[n + h] AS exit_date, cs[n:n + h] AS path FROM a JOIN g ON a.entity = g.entity, (SELECT unnest({list(REACTION_HORIZONS)}) AS h) WHERE n + h <= len(cs)),
b AS (SELECT p.*, path[-1] / nullif(p.close, 0) - 1 AS raw, m1.close / nullif(m0.close, 0) - 1 AS bench, list_transform(path[2:], lambda x, i: x / path[i] - 1) AS s FROM p LEFT JOIN market m0 ON p.anchor = m0.d LEFT JOIN market m1 ON p.exit_date = m1.d),
c AS (SELECT *, CAST(same_day > 1 AS INT) + CAST(abs(coalesce(bench, 0)) > 0.03 AS INT) + CAST(dividend_day AS INT) AS k FROM b)
SELECT event_id, entity, anchor, horizon, exit_date, round(raw, 6) AS raw, round(raw - bench, 6) AS abnormal, CASE WHEN len(s) > 1 THEN round(list_stddev_pop(s), 6) END AS volatility, round(list_max(path) / nullif(close, 0) - 1, 6) AS max_gain,
  round(list_min(path) / nullif(close, 0) - 1, 6) AS max_drawdown, list_position(path, list_max(path)) - 1 AS sessions_to_max, CASE WHEN k >= 2 THEN 'heavily_confounded' WHEN k = 1 THEN 'partially_confounded' ELSE 'clean_event' END AS confounding FROM c""")
def event_reaction(t: Tables) -> DataFrame:
    ev = urgent(t).withColumn("same_day_events", F.count(F.lit(1)).over(Window.partitionBy("entity", "event_d"))).withColumn("dividend_day", F.dayofmonth("event_d") == 15)
    out = E.reactions(t.panel().select("entity", "d", "close"), t.market(), ev, REACTION_HORIZONS)
    return out.select("event_id", "entity", "anchor", "horizon", "exit_date", *[round6(c).alias(c) for c in ("raw", "abnormal", "volatility", "max_gain", "max_drawdown")], "sessions_to_max", "confounding")


@query(f"""WITH {MIL}, x AS (SELECT event_id, entity, event_d, m.d - event_d AS k, m.d FROM ev JOIN market m ON m.d BETWEEN event_d - CASE WHEN event_id % 2 = 0 THEN 0 ELSE 5 END AND event_d + 20)
SELECT event_id, d, CASE WHEN k < 0 THEN 'pre_event' WHEN k = 0 THEN 'event_day' WHEN k = 1 THEN 'post_1' WHEN k <= 5 THEN 'post_5' ELSE 'post_20' END AS state FROM x""")
def event_timeline(t: Tables) -> DataFrame:
    return E.timeline(t.market(), urgent(t), F.col("event_id") % 2 == 0).select("event_id", "d", "state")


@query("""WITH a AS (SELECT *, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s, count(*) OVER w AS n FROM observations WINDOW w AS (PARTITION BY series ORDER BY observed, vintage ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT series, vintage, round(CASE WHEN s > 1e-9 THEN (value - m) / s END, 4) AS surprise, n FROM a""")
def surprise_vs_consensus(t: Tables) -> DataFrame:
    w = Window.partitionBy("series").orderBy("observed", "vintage").rowsBetween(-20, -1)
    a = t.observations().withColumn("m", F.avg("value").over(w)).withColumn("s", F.stddev_samp("value").over(w)).withColumn("n", F.count(F.lit(1)).over(w))
    return a.select("series", "vintage", F.round(E.surprise("value", "m", "s"), 4).alias("surprise"), "n")


@query("""WITH c AS (SELECT *, substr(sha256(user_id || '|' || event_type || '|' || CAST(ts AS DATE)), 1, 16) AS k, CASE event_type WHEN 'purchase' THEN 3 WHEN 'error' THEN 2 ELSE 1 END + event_id % 3 AS trust FROM events)
SELECT k, event_id, trust, first_known FROM (SELECT *, min(ts) OVER (PARTITION BY k) AS first_known, row_number() OVER (PARTITION BY k ORDER BY trust DESC, ts, event_id) AS n FROM c) WHERE n = 1""")
def dedup_primary(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    trust = F.when(kind == "purchase", 3).when(kind == "error", 2).otherwise(1) + F.col("event_id") % 3
    c = t("events").withColumn("k", key_hash("user_id", "event_type", F.to_date("ts"), length=16)).withColumn("trust", trust)
    return E.primary_source(c, ["k"], "trust", "ts").select("k", "event_id", "trust", "first_known")


def _match(pattern: str) -> str:
    return f"regexp_matches(lower(text), '{pattern}')"


@query(f"""SELECT doc_id, CASE {' '.join(f"WHEN {_match(p)} THEN '{n}'" for n, p in R.EVENT_CLASS)} ELSE 'other' END AS class,
  CASE WHEN {_match(R.POSITIVE)} AND {_match(R.NEGATIVE)} THEN 'mixed' WHEN {_match(R.POSITIVE)} THEN 'positive_wording' WHEN {_match(R.NEGATIVE)} THEN 'negative_wording' ELSE 'uncertain' END AS tone,
  array_to_string(list_filter([{', '.join(f"CASE WHEN {_match(p)} THEN '{n}' END" for n, p in sorted(R.ENTITY_PATTERNS.items()))}], lambda x: x IS NOT NULL), ',') AS entities FROM documents""")
def news_entities_tone(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", E.event_class("text").alias("class"), E.tone("text").alias("tone"), F.concat_ws(",", E.entities("text")).alias("entities"))


@query("""WITH r AS (SELECT substr(sha256(event_type || '|' || user_id % 10 || '|' || CAST(ts AS DATE)), 1, 16) AS story_id, ts, user_id AS source FROM events)
SELECT story_id, min(ts) AS first_report, max(ts) AS last_report, count(*) AS updates, count(DISTINCT source) AS sources, CASE WHEN count(DISTINCT source) >= 3 THEN 'confirmed' WHEN count(*) > 1 THEN 'developing' ELSE 'emerging' END AS status FROM r GROUP BY 1""")
def story_cluster(t: Tables) -> DataFrame:
    r = t("events").select(E.story_id(F.col("event_type"), F.array((F.col("user_id") % 10).cast("string")), F.to_date("ts")).alias("story_id"), "ts", F.col("user_id").alias("source"))
    return E.stories(r)


@query("SELECT event_id, CASE event_type WHEN 'purchase' THEN 'issuer' WHEN 'error' THEN 'sector' ELSE 'market' END AS relevance, round(CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END * least(value / 10, 1) * 0.8, 6) AS impact FROM events")
def event_impact(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    sign = F.when(kind == "purchase", 1).when(kind == "error", -1).otherwise(0)
    return t("events").select("event_id", F.when(kind == "purchase", "issuer").when(kind == "error", "sector").otherwise("market").alias("relevance"), round6(sign * F.least(F.col("value") / 10, F.lit(1.0)) * 0.8).alias("impact"))


@query("""WITH c AS (SELECT d, row_number() OVER (ORDER BY d) AS s FROM (SELECT DISTINCT d FROM market)), f AS (SELECT entity, panel.d AS cutoff, 20 AS horizon, close FROM panel), x AS (SELECT f.*, e.d AS matures FROM f JOIN c ON f.cutoff = c.d LEFT JOIN c e ON e.s = c.s + 20)
SELECT x.entity, cutoff, matures, CASE WHEN matures IS NULL THEN 'pending' WHEN o.d IS NULL THEN 'unpriced' ELSE 'matured' END AS status, round(o.close / nullif(x.close, 0) - 1, 6) AS outcome FROM x ASOF LEFT JOIN panel o ON x.entity = o.entity AND x.matures >= o.d""")
def forecast_maturity(t: Tables) -> DataFrame:
    f = t.panel().select("entity", F.col("d").alias("cutoff"), F.lit(20).alias("horizon"), F.col("close").alias("c0"))
    x = E.maturity(f, t.market())
    known = asof(x.where("matures IS NOT NULL"), t.panel().select("entity", "d", "close"), ["entity"], "matures", "d", ["close"])
    status = F.when(F.col("asof_d").isNull(), "unpriced").otherwise("matured")
    done = known.select("entity", "cutoff", "matures", status.alias("status"), round6(ratio("close", "c0") - 1).alias("outcome"))
    return done.unionByName(x.where("matures IS NULL").select("entity", "cutoff", "matures", F.lit("pending").alias("status"), F.lit(None).cast("double").alias("outcome")))


@query("""WITH r AS (SELECT entity, d, r, lag(r) OVER (PARTITION BY entity ORDER BY d) AS p FROM ret), s AS (SELECT entity, count(*) AS n, avg(abs(r - p)) AS a, avg(abs(r)) AS b FROM r WHERE r IS NOT NULL AND p IS NOT NULL GROUP BY 1)
SELECT entity, n, round(a, 6) AS model_error, round(b, 6) AS baseline_error, CASE WHEN a < b THEN 'model' ELSE 'baseline' END AS winner, CASE WHEN n < 100 THEN 'collecting' WHEN a < 0.95 * b THEN 'promote' WHEN a < b THEN 'watch' ELSE 'reject' END AS gate FROM s""")
def live_duels(t: Tables) -> DataFrame:
    r = returns(t.panel()).withColumn("p", F.lag("r").over(W.by_time("entity", "d"))).where("r IS NOT NULL AND p IS NOT NULL")
    s = r.groupBy("entity").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("r") - F.col("p"))).alias("a"), F.avg(F.abs("r")).alias("b"))
    a, b = F.col("a"), F.col("b")
    return s.select("entity", "n", round6("a").alias("model_error"), round6("b").alias("baseline_error"), F.when(a < b, "model").otherwise("baseline").alias("winner"),
                    F.when(F.col("n") < 100, "collecting").when(a < 0.95 * b, "promote").when(a < b, "watch").otherwise("reject").alias("gate"))


@query("""WITH m AS (SELECT entity, CAST(date_trunc('month', d) AS DATE) AS m, CASE WHEN avg(close) > 5000 THEN 'high' ELSE 'low' END AS status FROM panel GROUP BY 1, 2), x AS (SELECT *, lag(status) OVER w AS before, row_number() OVER w AS n FROM m WINDOW w AS (PARTITION BY entity ORDER BY m))
SELECT entity, m, status, before, CASE WHEN n = 1 THEN 'new' WHEN status IS NOT DISTINCT FROM before THEN 'unchanged' ELSE 'changed' END AS change FROM x""")
def snapshot_diff(t: Tables) -> DataFrame:
    m = t.panel().groupBy("entity", F.to_date(F.date_trunc("month", "d")).alias("m")).agg(F.when(F.avg("close") > 5000, "high").otherwise("low").alias("status"))
    return E.changes(m, ["entity"], "m", "status").select("entity", "m", "status", "before", "change")


@query("""WITH a AS (SELECT entity, arg_max(close, d) AS last, quantile_cont(close, 0.25) AS lo, quantile_cont(close, 0.75) AS hi FROM panel GROUP BY 1)
SELECT entity, round_even(lo / 5, 0) * 5 AS buy, round_even((lo + hi) / 2 / 5, 0) * 5 AS hold, round_even(hi / 5, 0) * 5 AS reduce, CASE WHEN last < lo THEN 'accumulate' WHEN last > hi THEN 'trim' ELSE 'wait' END AS verdict FROM a""")
def decision_zones(t: Tables) -> DataFrame:
    a = t.panel().groupBy("entity").agg(F.max_by("close", "d").alias("last"), F.percentile("close", 0.25).alias("lo"), F.percentile("close", 0.75).alias("hi")).withColumn("z", E.zones(F.col("lo"), F.col("hi")))
    verdict = F.when(F.col("last") < F.col("lo"), "accumulate").when(F.col("last") > F.col("hi"), "trim").otherwise("wait")
    return a.select("entity", *[F.element_at("z", k).getField("price").alias(n) for k, n in ((1, "buy"), (2, "hold"), (3, "reduce"))], verdict.alias("verdict"))


@query("""SELECT 'lineitem' AS table_name, count(*) AS rows, CAST(min(l_shipdate) AS DATE) AS first_d, CAST(max(l_shipdate) AS DATE) AS last_d FROM lineitem UNION ALL SELECT 'orders', count(*), CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE) FROM orders
UNION ALL SELECT 'events', count(*), CAST(min(ts) AS DATE), CAST(max(ts) AS DATE) FROM events""")
def data_inventory(t: Tables) -> DataFrame:
    parts = [t(n).agg(F.count("*").alias("rows"), F.to_date(F.min(c)).alias("first_d"), F.to_date(F.max(c)).alias("last_d")).withColumn("table_name", F.lit(n)) for n, c in (("lineitem", "l_shipdate"), ("orders", "o_orderdate"), ("events", "ts"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("table_name", "rows", "first_d", "last_d")


@query(f"""WITH x AS (SELECT *, strftime(ts, '%H:%M') AS clock FROM events), y AS (SELECT *, {R.case(R.SESSION_3, 'evening')} AS three, {R.case(R.SESSION_4, 'overnight')} AS four, {R.case(R.SESSION_5, 'evening')} AS five FROM x)
SELECT CAST(ts AS DATE) AS d, three, four, five, count(*) AS n, round(arg_min(value, (ts, event_id)), 6) AS open, round(arg_max(value, (ts, event_id)), 6) AS close, round(stddev_samp(value), 6) AS sd FROM y GROUP BY 1, 2, 3, 4""")
def intraday_sessions(t: Tables) -> DataFrame:
    """The three ways of cutting a day, with the first and last value of each part."""
    x = t("events").withColumn("clock", F.date_format("ts", "HH:mm"))
    at = F.struct("ts", "event_id")
    parts = [R.label(R.SESSION_3, "evening").alias("three"), R.label(R.SESSION_4, "overnight").alias("four"), R.label(R.SESSION_5, "evening").alias("five")]
    return x.groupBy(F.to_date("ts").alias("d"), *parts).agg(F.count("*").alias("n"), round6(F.min_by("value", at)).alias("open"), round6(F.max_by("value", at)).alias("close"), round6(F.stddev_samp("value")).alias("sd"))


@query("""WITH x AS (SELECT CAST(ts AS DATE) AS d, arg_min(value, (ts, event_id)) AS o, arg_max(value, (ts, event_id)) AS c, sum(ln(greatest(value, 0.01)) * ln(greatest(value, 0.01))) AS q FROM events GROUP BY 1) SELECT d, round(o / nullif(lag(c) OVER (ORDER BY d), 0) - 1, 6) AS overnight_gap, round(c / nullif(o, 0) - 1, 6) AS day_return, round(sqrt(q), 6) AS realised FROM x""")
def overnight_gap(t: Tables) -> DataFrame:
    at, g = F.struct("ts", "event_id"), F.log(F.greatest("value", F.lit(0.01)))
    x = t("events").groupBy(F.to_date("ts").alias("d")).agg(F.min_by("value", at).alias("o"), F.max_by("value", at).alias("c"), F.sum(g * g).alias("q"))
    return x.select("d", round6(ratio("o", F.lag("c").over(Window.orderBy("d"))) - 1).alias("overnight_gap"), round6(ratio("c", "o") - 1).alias("day_return"), round6(F.sqrt("q")).alias("realised"))


# The scalar surface

@query("""SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment, greatest(c_acctbal, 0) AS positive, least(c_acctbal, 100) AS capped, CASE WHEN isfinite(c_acctbal) THEN c_acctbal END AS finite, c_acctbal IS NULL AS missing FROM customer""")
def scalar_conditional(t: Tables) -> DataFrame:
    b = F.col("c_acctbal")
    return t("customer").select("c_custkey", F.coalesce(F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")), F.lit("none")).alias("segment"), F.greatest(b, F.lit(0.0)).alias("positive"), F.least(b, F.lit(100.0)).alias("capped"), finite(b).alias("finite"), b.isNull().alias("missing"))


@query("""SELECT p_partkey, round(abs(p_retailprice - 1000), 6) AS a, round(ln(p_retailprice), 6) AS l, round(exp(p_size / 100.0), 6) AS e, round(sqrt(p_size), 6) AS s, round(power(p_size, 1.5), 6) AS p, CAST(sign(p_size - 25) AS INT) AS g, round(ln(1 + p_size), 6) AS lp FROM part""")
def scalar_math(t: Tables) -> DataFrame:
    s, p = F.col("p_size"), F.col("p_retailprice")
    return t("part").select("p_partkey", round6(F.abs(p - 1000)).alias("a"), round6(F.log(p)).alias("l"), round6(F.exp(s / 100.0)).alias("e"), round6(F.sqrt(s)).alias("s"), round6(F.pow(s, F.lit(1.5))).alias("p"), F.signum((s - 25).cast("double")).cast("int").alias("g"), round6(F.log1p(s)).alias("lp"))


@query("""SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-12-31') AS age, CAST(o_orderdate AS DATE) + INTERVAL 90 DAY AS due, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, CAST(isodow(o_orderdate) AS INT) AS weekday,
  CAST((o_orderdate AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Moscow' AS TIMESTAMP) AS local_ts FROM orders""")
def scalar_date(t: Tables) -> DataFrame:
    d, ts = F.to_date("o_orderdate"), F.col("o_orderdate").cast("timestamp")
    return t("orders").select("o_orderkey", F.datediff(F.lit("2001-12-31").cast("date"), d).cast("long").alias("age"), F.date_add(d, 90).cast("timestamp_ntz").alias("due"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("quarter"), (F.weekday(d) + 1).alias("weekday"),
                             F.from_utc_timestamp(ts, "Europe/Moscow").cast("timestamp_ntz").alias("local_ts"))


@query("""SELECT p_partkey, lower(p_name) || ':' || upper(right(p_brand, 2)) AS label, p_type LIKE '%STEEL' AS steel, regexp_matches(p_type, '^(PROMO|ECONOMY)') AS campaign, substr(sha256(p_name), 1, 12) AS digest, CAST(length(p_name) AS INTEGER) AS n FROM part""")
def scalar_string(t: Tables) -> DataFrame:
    return t("part").select("p_partkey", F.concat(F.lower("p_name"), F.lit(":"), F.upper(F.right(F.col("p_brand"), F.lit(2)))).alias("label"), F.col("p_type").like("%STEEL").alias("steel"), F.col("p_type").rlike("^(PROMO|ECONOMY)").alias("campaign"), F.substring(F.sha2("p_name", 256), 1, 12).alias("digest"), F.length("p_name").alias("n"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, '{"id":' || event_id || ',"type":"' || event_type || '"}' AS packed FROM events""")
def scalar_json(t: Tables) -> DataFrame:
    return t("events").select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("packed"))


@query("""SELECT c_nationkey, array_to_string(list_sort(list(DISTINCT c_mktsegment)), '|') AS segments, len(list(c_custkey)) AS n, list_contains(list(c_mktsegment), 'BUILDING') AS building FROM customer GROUP BY 1""")
def scalar_list(t: Tables) -> DataFrame:
    return t("customer").groupBy("c_nationkey").agg(F.array_join(F.sort_array(F.collect_set("c_mktsegment")), "|").alias("segments"), F.size(F.collect_list("c_custkey")).cast("long").alias("n"), F.array_contains(F.collect_list("c_mktsegment"), "BUILDING").alias("building"))


@query("SELECT n_nationkey::VARCHAR AS k, n_regionkey::DOUBLE AS r, r.* EXCLUDE (r_regionkey) FROM nation JOIN region r ON n_regionkey = r_regionkey")
def scalar_cast(t: Tables) -> DataFrame:
    return t.spark.sql("SELECT n_nationkey::STRING AS k, n_regionkey::DOUBLE AS r, r.* EXCEPT (r_regionkey) FROM {n} n JOIN {r} r ON n_regionkey = r_regionkey", n=t("nation"), r=t("region"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"')) AS links, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages")
def html_fields(t: Tables) -> DataFrame:
    return t("pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit('<a href="([^"]*)"')).cast("long").alias("links"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"))


@query("SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles, arg_min(role, turn) AS opened_by, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1")
def conversation_rollup(t: Tables) -> DataFrame:
    return t("conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_distinct("role").alias("roles"), F.min_by("role", "turn").alias("opened_by"), F.sum(F.length("text")).alias("chars"))


@query("SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(t: Tables) -> DataFrame:
    """The streaming tumbling window, run over the whole table in available-now mode."""
    from chronoframe.streaming import streams as St

    return St.drained(t, "events", lambda s: St.tumbling(s, "ts", "1 hour", ["user_id"])).select("user_id", F.col("start").cast("timestamp_ntz").alias("hour"), "n", F.round("total", 4).alias("total"))


@query("""WITH x AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events))
SELECT user_id, min(ts) AS first_ts, count(*) AS n FROM x GROUP BY user_id, s""")
def stream_session(t: Tables) -> DataFrame:
    from chronoframe.streaming import streams as St

    return St.drained(t, "events", lambda s: St.sessions(s, "ts", "6 hours", "user_id")).select("user_id", F.col("start").cast("timestamp_ntz").alias("first_ts"), "n")


@query("SELECT user_id, event_type, CAST(ts AS DATE) AS d FROM events GROUP BY 1, 2, 3")
def stream_dedup(t: Tables) -> DataFrame:
    from chronoframe.streaming import streams as St

    return St.drained(t, "events", lambda s: St.first_seen(s.withColumn("d", F.to_date("ts")), "ts", ["user_id", "event_type", "d"], "40 days")).select("user_id", "event_type", "d")


@query("SELECT event_type AS story, count(*) AS updates, count(DISTINCT user_id) AS sources, min(ts) AS first_report FROM events GROUP BY 1")
def stream_story_state(t: Tables) -> DataFrame:
    """Stories kept in custom state; the last state of each."""
    from chronoframe.streaming import streams as St

    out = St.drained(t, "events", lambda s: St.story_state(s, "event_type", "ts", "user_id"), mode="update")
    return W.latest(out, ["story"], [F.col("updates").desc()]).select("story", "updates", "sources", F.col("first_report").cast("timestamp_ntz").alias("first_report"))


