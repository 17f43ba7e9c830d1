"""Data-quality, availability and gate queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions.expr import count_if, key_hash, ratio, round6, share
from chronoframe.operators import quality as Q
from chronoframe.operators import rules as R
from chronoframe.operators import scoring as Sc
from chronoframe.operators.panel import canonical, returns
from chronoframe.plans.bindings import Tables
from chronoframe.queries.panel import SEGMENTS, _segments
from chronoframe.queries.registry import query

#: Defects put into the panel by rule, so that the rules have something to find.
DIRTY = """dirty AS (SELECT entity, d, CASE WHEN (entity + day(d)) % 97 = 0 THEN high * 1.5 ELSE open END AS open, CASE WHEN (entity + day(d)) % 89 = 0 THEN low - 1 ELSE high END AS high, low,
  CASE WHEN (entity + day(d)) % 83 = 0 THEN -close WHEN (entity + day(d)) % 79 = 0 THEN NULL ELSE close END AS close, value, CASE WHEN (entity + day(d)) % 73 = 0 THEN -volume ELSE volume END AS volume FROM panel)"""


def dirty(t: Tables) -> DataFrame:
    k = F.col("entity") + F.dayofmonth("d")
    hit = lambda m, x, c: F.when(k % m == 0, x).otherwise(F.col(c)).alias(c)
    close = F.when(k % 83 == 0, -F.col("close")).when(k % 79 == 0, F.lit(None)).otherwise(F.col("close")).alias("close")
    return t.panel().select("entity", "d", hit(97, F.col("high") * 1.5, "open"), hit(89, F.col("low") - 1, "high"), "low", close, "value", hit(73, -F.col("volume"), "volume"))


@query(f"""WITH {DIRTY}, r AS (
  SELECT 'negative_price' AS issue_type, entity, d FROM dirty WHERE least(open, high, low, close) < 0
  UNION ALL SELECT 'negative_volume', entity, d FROM dirty WHERE volume < 0 UNION ALL SELECT 'high_below_low', entity, d FROM dirty WHERE high < low
  UNION ALL SELECT 'open_outside_range', entity, d FROM dirty WHERE open > high OR open < low UNION ALL SELECT 'close_outside_range', entity, d FROM dirty WHERE close > high OR close < low
  UNION ALL SELECT 'missing_required', entity, d FROM dirty WHERE close IS NULL OR volume IS NULL OR value IS NULL) SELECT issue_type, entity, d, '' AS detail FROM r""")
def quality_row_rules(t: Tables) -> DataFrame:
    return Q.row_rules(dirty(t))


@query("""WITH x AS (SELECT *, lag(close) OVER w AS p, lag(volume) OVER w AS v FROM panel WINDOW w AS (PARTITION BY entity ORDER BY d))
SELECT issue_type, count(*) AS n, count(DISTINCT entity) AS entities, min(d) AS first_d FROM (SELECT 'price_scale' AS issue_type, entity, d FROM x WHERE close / nullif(p, 0) >= 10 OR close / nullif(p, 0) <= 0.1
UNION ALL SELECT 'volume_scale', entity, d FROM x WHERE volume / nullif(v, 0) >= 100) GROUP BY 1""")
def scale_jump(t: Tables) -> DataFrame:
    return Q.scale_jumps(t.panel()).groupBy("issue_type").agg(F.count("*").alias("n"), F.count_distinct("entity").alias("entities"), F.min("d").alias("first_d"))


@query("""WITH c AS (SELECT d, row_number() OVER (ORDER BY d) AS s FROM (SELECT DISTINCT d FROM market)), x AS (SELECT entity, panel.d, s - lag(s) OVER (PARTITION BY entity ORDER BY panel.d) - 1 AS gap FROM panel JOIN c ON panel.d = c.d)
SELECT 'missing_sessions' AS issue_type, entity, d, CAST(gap AS VARCHAR) AS detail FROM x WHERE gap > 20""")
def gap_check(t: Tables) -> DataFrame:
    return Q.calendar_gaps(t.panel(), t.market(), 20)


@query(f"""WITH {SEGMENTS}, x AS (SELECT *, max(valid_to) OVER (PARTITION BY entity ORDER BY valid_from, board ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM seg)
SELECT 'segment_overlap' AS issue_type, entity, valid_from AS d, board AS detail FROM x WHERE valid_from <= before UNION ALL SELECT 'segment_gap', entity, valid_from, board FROM x WHERE valid_from - before > 1""")
def segment_quality(t: Tables) -> DataFrame:
    return Q.segment_issues(_segments(t))


@query(f"""WITH {SEGMENTS}, ch AS (SELECT entity, d, board, close FROM (SELECT b.*, row_number() OVER (PARTITION BY b.entity, d ORDER BY priority DESC, b.board) AS n FROM boards b JOIN seg s ON b.entity = s.entity AND b.board = s.board AND d BETWEEN valid_from AND valid_to) WHERE n = 1),
x AS (SELECT *, lag(board) OVER w AS b, close / nullif(lag(close) OVER w, 0) - 1 AS m FROM ch WINDOW w AS (PARTITION BY entity ORDER BY d))
SELECT 'board_boundary_jump' AS issue_type, entity, d, b || '>' || board AS detail FROM x WHERE b <> board AND abs(m) > 0.25""")
def board_boundary_jump(t: Tables) -> DataFrame:
    return Q.board_jumps(canonical(t.boards(), _segments(t)))


@query("""SELECT 'orphan_fact' AS issue_type, s.s_suppkey AS entity, CAST(o_orderdate AS DATE) AS d, '' AS detail FROM (SELECT DISTINCT o_custkey % 100 + 1 AS s_suppkey, o_orderdate FROM orders) s
WHERE NOT EXISTS (SELECT 1 FROM panel p WHERE p.entity = s.s_suppkey AND p.d = CAST(o_orderdate AS DATE))""")
def orphan_facts(t: Tables) -> DataFrame:
    facts = t("orders").select((F.col("o_custkey") % 100 + 1).alias("entity"), "o_orderdate").distinct().select("entity", F.to_date("o_orderdate").alias("d"))
    return Q.orphans(facts, t.panel(), "orphan_fact")


@query("""WITH r AS (SELECT entity, board, d, close / nullif(lag(close) OVER (PARTITION BY entity, board ORDER BY d), 0) - 1 AS r, close, value, volume FROM boards),
u AS (SELECT 'large_return_corporate_action_review' AS issue, entity, board, d, round(r, 4) AS r FROM r WHERE abs(r) > 0.5 UNION ALL SELECT 'nonpositive_close', entity, board, d, NULL FROM r WHERE close <= 0 UNION ALL SELECT 'value_below_close', entity, board, d, NULL FROM r WHERE value < close)
SELECT substr(sha256(issue || ':' || entity || ':' || board || ':' || d), 1, 24) AS issue_id, * FROM u""")
def market_history_audit(t: Tables) -> DataFrame:
    rules = {"nonpositive_close": F.col("close") <= 0, "value_below_close": F.col("value") < F.col("close")}
    return Q.history_audit(t.boards(), rules).withColumn("r", F.round("r", 4))


@query("""WITH x AS (SELECT *, lag(observed) OVER w AS po, lag(value) OVER w AS pv, count(*) OVER (PARTITION BY series, observed, vintage) AS n FROM observations WINDOW w AS (PARTITION BY series ORDER BY observed, vintage))
SELECT series, count(*) FILTER (WHERE available < observed) AS leaked, count(*) FILTER (WHERE n > 1) AS duplicated, count(*) FILTER (WHERE observed - po > 10) AS gaps, count(*) FILTER (WHERE abs(value / nullif(pv, 0) - 1) > 10) AS jumps FROM x GROUP BY 1""")
def macro_quality(t: Tables) -> DataFrame:
    w = Window.partitionBy("series").orderBy("observed", "vintage")
    x = t.observations().withColumn("po", F.lag("observed").over(w)).withColumn("pv", F.lag("value").over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("series", "observed", "vintage")))
    return x.groupBy("series").agg(count_if(F.col("available") < F.col("observed")).alias("leaked"), count_if(F.col("n") > 1).alias("duplicated"), count_if(F.datediff("observed", "po") > 10).alias("gaps"), count_if(F.abs(ratio("value", "pv") - 1) > 10).alias("jumps"))


@query("""WITH f AS (SELECT (['assets', 'equity', 'revenue'])[o_orderkey % 3 + 1] AS metric, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period_end, (['IFRS', 'RAS', 'GAAP'])[o_custkey % 3 + 1] AS standard, o_custkey % 50 AS revision, CAST(o_orderdate AS DATE) - CAST(o_orderkey % 11 AS INT) AS published,
  CAST(o_orderdate AS DATE) - CAST(o_orderkey % 13 AS INT) AS available, o_totalprice - 20000 AS value FROM orders), x AS (SELECT *, row_number() OVER (PARTITION BY metric, period_end, standard, revision ORDER BY published, available, value) AS k FROM f),
i AS (SELECT metric, period_end, standard, revision, unnest(list_filter([CASE WHEN k > 1 THEN 'duplicate' END, CASE WHEN published < period_end THEN 'publication_before_period_end' END, CASE WHEN available < published THEN 'available_before_publication' END, CASE WHEN standard NOT IN ('IFRS', 'RAS') THEN 'unknown_standard' END,
  CASE WHEN metric IN ('assets', 'equity', 'ordinary_shares', 'client_funds') AND value < 0 THEN 'impossible_negative' END], lambda x: x IS NOT NULL)) AS issue FROM x)
SELECT metric, period_end, standard, issue, count(*) AS n FROM i GROUP BY 1, 2, 3, 4""")
def fundamental_quality(t: Tables) -> DataFrame:
    pick = lambda names, c: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col(c) % 3 + 1).cast("int"))
    day = F.to_date("o_orderdate")
    facts = t("orders").select(pick(("assets", "equity", "revenue"), "o_orderkey").alias("metric"), F.to_date(F.date_trunc("quarter", day)).alias("period_end"), pick(("IFRS", "RAS", "GAAP"), "o_custkey").alias("standard"), (F.col("o_custkey") % 50).alias("revision"),
                               F.date_sub(day, (F.col("o_orderkey") % 11).cast("int")).alias("published"), F.date_sub(day, (F.col("o_orderkey") % 13).cast("int")).alias("available"), (F.col("o_totalprice") - 20000).alias("value"))
    return Q.fundamental_issues(facts).groupBy("metric", "period_end", "standard", "issue").agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT event_id, CASE WHEN event_id % 17 <> 0 THEN ts + INTERVAL 1 HOUR * (event_id % 5 - 1) END AS available, ts AS announced, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 1 HOUR * (event_id % 7 - 2) END AS effective, CASE WHEN event_id % 19 <> 0 THEN ts END AS start,
  event_id % 4 = 0 AS scheduled, event_type = 'error' AS surprise, user_id || '|' || event_type || '|' || strftime(ts, '%Y-%m-%d %H') AS h, CASE WHEN event_id % 11 = 0 THEN 'manual_review' ELSE 'validated' END AS status, CASE WHEN event_id % 23 <> 0 THEN 'http://x' END AS url FROM events),
y AS (SELECT *, min(event_id) OVER (PARTITION BY h) AS f FROM x)
SELECT event_id, unnest(list_filter([CASE WHEN available IS NULL THEN 'missing_available_from' END, CASE WHEN announced > available THEN 'publication_leakage' END, CASE WHEN scheduled AND surprise THEN 'schedule_conflict' END, CASE WHEN status = 'validated' AND start IS NULL THEN 'missing_event_time' END,
  CASE WHEN effective < announced THEN 'effective_before_announcement' END, CASE WHEN f < event_id THEN 'duplicate_source_copy' END, CASE WHEN url IS NULL THEN 'missing_source' END, CASE WHEN status = 'manual_review' THEN 'manual_review' END], lambda x: x IS NOT NULL)) AS issue FROM y""")
def event_validation(t: Tables) -> DataFrame:
    k = F.col("event_id")
    hours = lambda n: F.col("ts") + F.make_dt_interval(F.lit(0), n.cast("int"))
    events = t("events").select("event_id", F.when(k % 17 != 0, hours(k % 5 - 1)).alias("available_from"), F.col("ts").alias("announcement_time"), F.when(k % 3 == 0, hours(k % 7 - 2)).alias("effective_time"), F.when(k % 19 != 0, F.col("ts")).alias("event_start"),
                                (k % 4 == 0).alias("scheduled"), (F.col("event_type") == "error").alias("surprise"), F.concat_ws("|", F.col("user_id").cast("string"), "event_type", F.date_format("ts", "yyyy-MM-dd HH")).alias("content_hash"),
                                F.when(k % 11 == 0, "manual_review").otherwise("validated").alias("status"), F.when(k % 23 != 0, "http://x").alias("source_url"))
    return Q.event_issues(events).select("event_id", "issue")


SECURITY = """q AS (SELECT entity, date_diff('day', min(d), max(d)) / 365.25 AS years, count(*) AS observations, avg(CAST(open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR value < 3000 AS INT)) AS missing, avg(CAST(volume > 1 AS INT)) AS volume_coverage, avg(CAST(trades >= 1 AS INT)) AS trade_coverage, count(*) FILTER (WHERE high > low * 100) AS flags FROM panel GROUP BY 1),
b AS (SELECT entity, count(DISTINCT board) AS boards FROM boards GROUP BY 1)"""


def securities(t: Tables) -> DataFrame:
    """(entity, years, observations, missing, volume_coverage, trade_coverage, flags, boards): what is known of
    each entity's history; values under 3000 stand for missing prices, volumes of 1 for missing volumes."""
    gap = F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("close").isNull() | (F.col("value") < 3000)
    q = t.panel().groupBy("entity").agg((F.datediff(F.max("d"), F.min("d")) / 365.25).alias("years"), F.count("*").alias("observations"), share(gap).alias("missing"), share(F.col("volume") > 1).alias("volume_coverage"), share(F.col("trades") >= 1).alias("trade_coverage"), count_if(F.col("high") > F.col("low") * 100).alias("flags"))
    return q.join(t.boards().groupBy("entity").agg(F.count_distinct("board").alias("boards")), "entity")


@query(f"""WITH {SECURITY}, x AS (SELECT q.*, boards FROM q JOIN b ON q.entity = b.entity) SELECT entity, round(years, 6) AS years, observations, boards, flags, round((1 - missing + volume_coverage + trade_coverage) / 3, 6) AS score, {R.case(R.SECURITY_TIER, 'excluded')} AS tier, nullif({R.case(R.SECURITY_REASON, '')}, '') AS reason FROM x""")
def security_tiers(t: Tables) -> DataFrame:
    return Sc.security_quality(securities(t)).select("entity", round6("years").alias("years"), "observations", "boards", "flags", round6("feature_coverage").alias("score"), "tier", "reason")


@query(f"""WITH {SECURITY}, e AS (SELECT entity, count(*) AS episodes, count(*) FILTER (WHERE year(d) % 2 = 0) AS resolved FROM ret WHERE abs(r) > 10 GROUP BY 1), s AS (SELECT entity, count(DISTINCT year(d)) AS periods FROM panel GROUP BY 1),
x AS (SELECT q.*, boards, periods, coalesce(episodes, 0) AS episodes, coalesce(resolved, 0) AS resolved, coalesce(episodes, 0) - coalesce(resolved, 0) AS unresolved FROM q JOIN b ON q.entity = b.entity JOIN s ON q.entity = s.entity LEFT JOIN e ON q.entity = e.entity),
y AS (SELECT *, CASE WHEN episodes = 0 THEN 1 ELSE resolved::DOUBLE / episodes END AS resolution FROM x)
SELECT entity, unresolved, round(resolution, 6) AS resolution, round(100 * (0.20 * least(years / 10, 1) + 0.15 * (1 - missing) + 0.15 * volume_coverage + 0.10 * trade_coverage + 0.10 * (CASE WHEN boards = 1 THEN 1 ELSE 0.8 END) + 0.15 * resolution + 0.10 * 0.8 + 0.05 * least(periods / 5.0, 1)), 6) AS score,
  {R.case(R.QUALITY_TIER, 'excluded')} AS tier, nullif({R.case(R.QUALITY_REASON, '')}, '') AS reason FROM y""")
def quality_policy(t: Tables) -> DataFrame:
    """Second policy; returns over 10 stand for corporate-action episodes, resolved in even years."""
    e = returns(t.panel()).where(F.abs("r") > 10).groupBy("entity").agg(F.count("*").alias("episodes"), count_if(F.year("d") % 2 == 0).alias("resolved"))
    s = t.panel().groupBy("entity").agg(F.count_distinct(F.year("d")).alias("periods"))
    rows = securities(t).join(s, "entity").join(e, "entity", "left").fillna(0, ["episodes", "resolved"])
    return Sc.quality_policy(rows).select("entity", "unresolved", round6("resolution").alias("resolution"), round6("score").alias("score"), "tier", "reason")


@query(f"""WITH {SECURITY}, x AS (SELECT *, (1 - missing + volume_coverage + trade_coverage) / 3 AS coverage FROM q), y AS (SELECT *, {R.case(R.SECURITY_TIER, 'excluded')} AS tier FROM x), h AS (SELECT unnest([5, 20, 60, 120]) AS h)
SELECT entity, h AS horizon, greatest(observations - h, 0) AS samples, round(greatest(observations - h, 0)::DOUBLE / h, 6) AS independent, CASE WHEN years >= 10 THEN 4 WHEN years >= 5 THEN 2 ELSE 1 END AS rating, round(1 - coverage, 6) AS missingness, tier IN ('A', 'B') AND observations >= h * 10 AS adequate, tier FROM y, h""")
def training_adequacy(t: Tables) -> DataFrame:
    out = Sc.training_adequacy(Sc.security_quality(securities(t)))
    return out.select("entity", "horizon", "samples", round6("independent").alias("independent"), "rating", round6("missingness").alias("missingness"), "adequate", "tier")


@query("""WITH s AS (SELECT series, avg(CAST(available > observed AS INT)) = 1 AS ordered, count(DISTINCT vintage) > count(DISTINCT observed) AS revisions, count(*) - count(DISTINCT (observed, vintage)) AS dup, count(*) FILTER (WHERE observed > DATE '2002-01-01') AS imp, avg(CAST(available - observed > 5 AS INT)) AS stale FROM observations GROUP BY 1)
SELECT series, greatest(0.0::DOUBLE, round(100.0::DOUBLE - (CASE WHEN ordered THEN 0 ELSE 30 END + CASE WHEN revisions THEN 0 ELSE 10 END + least(15, dup * 3) + least(15, imp * 5) + least(10.0, stale * 20)), 1)) AS score FROM s""")
def pit_integrity(t: Tables) -> DataFrame:
    s = t.observations().groupBy("series").agg((share(F.col("available") > F.col("observed")) == 1).alias("ordered"), (F.count_distinct("vintage") > F.count_distinct("observed")).alias("revisions"),
                                               (F.count("*") - F.count_distinct("observed", "vintage")).alias("dup"), count_if(F.col("observed") > F.lit("2002-01-01").cast("date")).alias("imp"), share(F.datediff("available", "observed") > 5).alias("stale"))
    return s.select("series", R.integrity(F.lit(True), F.col("ordered"), F.col("revisions"), F.col("dup"), F.col("imp"), F.col("stale"), F.lit(True)).alias("score"))


@query("""WITH l AS (SELECT entity, max(d) AS last_d FROM panel GROUP BY 1), o AS (SELECT max(available) AS c FROM observations), f AS (SELECT max(available) AS f FROM statements), n AS (SELECT max(d) AS now FROM market)
SELECT entity, now - last_d AS price_age, now - last_d <= 4 AS price_ok, concat_ws(';', CASE WHEN now - last_d > 4 THEN 'stale_price' END, CASE WHEN now - c > 10 THEN 'stale_context' END, CASE WHEN now - f > 550 THEN 'stale_fundamentals' END) AS reasons FROM l, o, f, n""")
def freshness_gates(t: Tables) -> DataFrame:
    now = t.market().agg(F.max("d").alias("now"))
    c, f = t.observations().agg(F.max("available").alias("c")), t.statements().agg(F.max("available").alias("f"))
    rows = t.panel().groupBy("entity").agg(F.max("d").alias("last_d")).join(F.broadcast(now)).join(F.broadcast(c)).join(F.broadcast(f))
    age = F.datediff("now", "last_d")
    reasons = F.concat_ws(";", F.when(age > 4, "stale_price"), F.when(F.datediff("now", "c") > 10, "stale_context"), F.when(F.datediff("now", "f") > 550, "stale_fundamentals"))
    return rows.select("entity", age.cast("long").alias("price_age"), (age <= 4).alias("price_ok"), reasons.alias("reasons"))


@query("SELECT series, count(*) AS known, max(available) AS last_known, max(observed) AS last_observed FROM observations WHERE available <= DATE '1998-06-30' GROUP BY 1")
def availability_filter(t: Tables) -> DataFrame:
    known = Q.require_no_future(t.observations().where(F.col("available") <= F.lit("1998-06-30").cast("date")), "observed", "available")
    return known.groupBy("series").agg(F.count("*").alias("known"), F.max("available").alias("last_known"), F.max("observed").alias("last_observed"))


@query("""WITH o AS (SELECT DISTINCT series, available FROM observations), g AS (SELECT m.d, series FROM market m CROSS JOIN (SELECT DISTINCT series FROM observations)), x AS (SELECT g.series, g.d - o.available AS age FROM g ASOF JOIN o ON g.series = o.series AND g.d >= o.available)
SELECT series, max(age) AS max_age, round(avg(age), 6) AS mean_age FROM x GROUP BY 1""")
def forward_fill_age(t: Tables) -> DataFrame:
    from chronoframe.operators.joins import asof
    from chronoframe.queries.joins import _grid

    o = t.observations().select("series", "available").distinct()
    x = asof(_grid(t), o, ["series"], "d", "available", [], inner=True, bucket="quarter").withColumn("age", F.datediff("d", "asof_available"))
    return x.groupBy("series").agg(F.max("age").cast("long").alias("max_age"), round6(F.avg("age")).alias("mean_age"))


@query("""WITH m AS (SELECT c_custkey AS member, c_nationkey AS idx, DATE '1995-01-01' + CAST(c_custkey % 900 AS INT) AS a, DATE '1996-06-01' + CAST(c_custkey % 1100 AS INT) AS b, DATE '1995-01-05' + CAST(c_custkey % 900 AS INT) AS known FROM customer)
SELECT idx, count(*) AS members FROM m WHERE a <= DATE '1997-01-01' AND (b IS NULL OR b > DATE '1997-01-01') AND known <= DATE '1997-01-01' GROUP BY 1""")
def index_members_as_of(t: Tables) -> DataFrame:
    at = lambda base, m: F.date_add(F.lit(base).cast("date"), (F.col("c_custkey") % m).cast("int"))
    m = t("customer").select(F.col("c_nationkey").alias("idx"), at("1995-01-01", 900).alias("a"), at("1996-06-01", 1100).alias("b"), at("1995-01-05", 900).alias("known"))
    day = F.lit("1997-01-01").cast("date")
    return m.where((F.col("a") <= day) & (F.col("b").isNull() | (F.col("b") > day)) & (F.col("known") <= day)).groupBy("idx").agg(F.count("*").alias("members"))


@query("""WITH s AS (SELECT s_suppkey AS entity, s_nationkey AS sector, DATE '1995-01-01' + CAST(s_suppkey % 10 * 100 AS INT) AS a, DATE '1995-01-01' + CAST(s_suppkey % 10 * 100 + 150 AS INT) AS b FROM supplier),
x AS (SELECT *, lag(b) OVER (PARTITION BY sector ORDER BY a, entity) AS pb, count(*) OVER (PARTITION BY sector, a) AS same FROM s) SELECT entity, sector, a AS valid_from, pb >= a AS overlaps, same > 1 AS duplicated FROM x""")
def membership_validation(t: Tables) -> DataFrame:
    at = lambda extra: F.date_add(F.lit("1995-01-01").cast("date"), (F.col("s_suppkey") % 10 * 100 + extra).cast("int"))
    s = t("supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("sector"), at(0).alias("a"), at(150).alias("b"))
    w = Window.partitionBy("sector").orderBy("a", "entity")
    return s.select("entity", "sector", F.col("a").alias("valid_from"), (F.lag("b").over(w) >= F.col("a")).alias("overlaps"), (F.count(F.lit(1)).over(Window.partitionBy("sector", "a")) > 1).alias("duplicated"))


@query("""WITH x AS (SELECT p_partkey, nullif(p_size % 3, 0) AS spot_scale, p_size AS futures_scale, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS multiplier, p_partkey % 4 AS lot, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'RUB' END AS currency, DATE '2001-01-01' AS expiration, CASE WHEN p_partkey % 11 <> 0 THEN 'd' || p_partkey END AS doc, p_retailprice / 2000 AS confidence, p_size % 6 = 0 AS legal FROM part)
SELECT p_partkey, array_to_string(list_filter([CASE WHEN spot_scale IS NULL THEN 'spot_scale' END, CASE WHEN futures_scale = 0 THEN 'futures_scale' END, CASE WHEN multiplier IS NULL THEN 'multiplier' END, CASE WHEN lot = 0 THEN 'lot' END, CASE WHEN currency = '' THEN 'currency' END], lambda x: x IS NOT NULL), ',') AS futures_missing,
  CASE WHEN doc IS NOT NULL AND multiplier IS NOT NULL AND confidence >= 0.9 THEN 'validated' ELSE 'requires_manual_review' END AS review, array_to_string(list_filter([CASE WHEN doc IS NULL THEN 'document_id' END, CASE WHEN multiplier IS NULL THEN 'candidate_value' END], lambda x: x IS NOT NULL), ',') AS review_missing,
  array_to_string(list_filter([CASE WHEN doc IS NULL OR currency = '' THEN 'both SECID required' END, CASE WHEN coalesce(multiplier, 0) <= 0 THEN 'positive conversion ratio required' END, CASE WHEN NOT legal THEN 'legal continuity evidence required' END], lambda x: x IS NOT NULL), ',') AS identity_errors FROM x""")
def evidence_gates(t: Tables) -> DataFrame:
    k, size, price = F.col("p_partkey"), F.col("p_size"), F.col("p_retailprice")
    rows = t("part").select("p_partkey", F.nullif(size % 3, F.lit(0)).alias("spot_scale"), size.alias("futures_scale"), F.when(k % 7 != 0, price).alias("multiplier"), (k % 4).alias("lot"), F.when(k % 5 == 0, "").otherwise("RUB").alias("currency"), F.lit("2001-01-01").alias("expiration"),
                            F.when(k % 11 != 0, F.concat(F.lit("d"), k.cast("string"))).alias("document_id"), (price / 2000).alias("confidence"), (size % 6 == 0).alias("legal"), *[F.lit("x").alias(c) for c in Sc.REVIEW_FIELDS[1:]])
    rows = Sc.review_gate(rows.withColumn("candidate_value", F.col("multiplier")))
    return rows.select("p_partkey", F.array_join(Sc.missing_fields(*Sc.FUTURES_UNITS), ",").alias("futures_missing"), F.col("status").alias("review"), F.array_join("missing", ",").alias("review_missing"), F.array_join(Sc.identity_gate("document_id", "currency", "multiplier", "legal"), ",").alias("identity_errors"))


@query("SELECT substr(sha256(entity || '|' || count(*) || '|' || max(d)), 1, 20) AS run_id, entity FROM panel GROUP BY entity")
def deterministic_run_ids(t: Tables) -> DataFrame:
    rows = t.panel().groupBy("entity").agg(F.count("*").alias("n"), F.max("d").alias("d"))
    return rows.select(key_hash("entity", "n", "d", length=20).alias("run_id"), "entity")


