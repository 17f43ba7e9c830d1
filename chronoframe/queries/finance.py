"""Derivatives, rates, macro, fundamentals and valuation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions.expr import ratio, round6, round_binary, share
from chronoframe.operators import finance as Fi
from chronoframe.operators import windows as W
from chronoframe.operators.scoring import fundamental_confidence as fundamental_score
from chronoframe.operators.panel import board_chain, returns
from chronoframe.plans.bindings import Tables
from chronoframe.queries.registry import query

#: Contracts: every entity of the panel, each expiring at the end of a quarter of its own; trades stand
#: for the open interest.
CONTRACTS = """contracts AS (SELECT d, entity AS contract, DATE '1995-03-31' + CAST(entity * 91 AS INT) AS expiry, close, volume, trades AS open_interest FROM panel)"""


CHAIN = CONTRACTS + """, live AS (SELECT *, row_number() OVER w AS n, first_value(expiry) OVER w AS fe, count(*) OVER (PARTITION BY d) AS k FROM contracts WHERE d <= expiry WINDOW w AS (PARTITION BY d ORDER BY expiry, contract)),
chain AS (SELECT d, contract, expiry, close, volume FROM live WHERE n = CASE WHEN fe - d <= 10 AND k > 1 THEN 2 ELSE 1 END)"""
ROLLS = CHAIN + """, ch AS (SELECT *, lag(contract) OVER (ORDER BY d) AS old FROM chain), rolls AS (SELECT ch.d, ch.old, ch.contract AS new, ch.close AS new_close, o.close AS old_close, ch.close - o.close AS difference, ch.close / nullif(o.close, 0) AS ratio
  FROM ch LEFT JOIN contracts o ON o.d = ch.d AND o.contract = ch.old WHERE ch.old <> ch.contract)"""


def contracts(t: Tables) -> DataFrame:
    return t.panel().select("d", F.col("entity").alias("contract"), F.date_add(F.lit("1995-03-31").cast("date"), (F.col("entity") * 91).cast("int")).alias("expiry"), "close", "volume", F.col("trades").alias("open_interest"))


def chain(t: Tables) -> DataFrame:
    return Fi.continuous(contracts(t), 10)


@query(f"WITH {CHAIN} SELECT d, contract, expiry, close FROM chain")
def continuous_contract(t: Tables) -> DataFrame:
    return chain(t).select("d", "contract", "expiry", "close")


_PICK = {"expiry": "near", "volume": "sv > v", "open_interest": "so > oi", "combined": "near OR (sv > v AND so > oi)"}


@query(f"""WITH {CONTRACTS}, live AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY expiry, contract) AS n FROM contracts WHERE d <= expiry),
p AS (SELECT f.d, f.contract AS front, s.contract AS next, f.close AS fc, s.close AS sc, f.expiry - f.d <= 5 AS near, coalesce(f.volume, 0) AS v, coalesce(s.volume, 0) AS sv, coalesce(f.open_interest, 0) AS oi, coalesce(s.open_interest, 0) AS so FROM (SELECT * FROM live WHERE n = 1) f LEFT JOIN (SELECT * FROM live WHERE n = 2) s ON f.d = s.d),
u AS ({' UNION ALL '.join(f"SELECT *, '{r}' AS rule, next IS NOT NULL AND ({c}) AS roll FROM p" for r, c in _PICK.items())})
SELECT d, rule, front, next, CASE WHEN roll THEN next ELSE front END AS contract, CASE WHEN roll THEN sc ELSE fc END AS close FROM u""")
def continuous_rules(t: Tables) -> DataFrame:
    """The chain by each of the four rules."""
    parts = [Fi.continuous(contracts(t), 5, rule).select("d", F.lit(rule).alias("rule"), "front", "next", "contract", "close") for rule in Fi.ROLL_RULES]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_CROSS = {"liquidity": "n.volume > o.volume", "open_interest": "n.open_interest > o.open_interest", "expiry": "o.expiry - o.d <= 5"}


@query(f"""WITH {CONTRACTS}, j AS (SELECT o.contract AS old, n.contract AS new, o.d, o.close AS oc, n.close AS nc, {', '.join(f'{c} AS {r}' for r, c in _CROSS.items())} FROM contracts o JOIN contracts n ON n.contract = o.contract + 1 AND n.d = o.d),
u AS ({' UNION ALL '.join(f"SELECT old, new, '{r}' AS rule, coalesce(min(d) FILTER (WHERE {r}), max(d)) AS d FROM j GROUP BY 1, 2" for r in _CROSS)})
SELECT u.old, u.new, u.rule, u.d, round(nc - oc, 6) AS difference, round(nc / nullif(oc, 0), 6) AS ratio FROM u JOIN j ON u.old = j.old AND u.new = j.new AND u.d = j.d""")
def crossover_rolls(t: Tables) -> DataFrame:
    """Each contract with the next one: when to roll by liquidity, open interest and expiry."""
    pairs = t.panel().select(F.col("entity").alias("old"), (F.col("entity") + 1).alias("new")).distinct()
    parts = [Fi.crossovers(contracts(t), pairs, rule, 5).select("old", "new", F.lit(rule).alias("rule"), "d", round6("difference").alias("difference"), round6("ratio").alias("ratio")) for rule in _CROSS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {ROLLS} SELECT d, old, new, round(difference, 6) AS difference, round(ratio, 6) AS ratio FROM rolls")
def futures_rolls(t: Tables) -> DataFrame:
    return Fi.rolls(chain(t), contracts(t)).select("d", "old", "new", round6("difference").alias("difference"), round6("ratio").alias("ratio"))


@query(f"""WITH {ROLLS} SELECT chain.d, chain.contract, round(chain.close + coalesce(sum(difference) OVER l, 0), 4) AS back_adjusted, round(chain.close * exp(coalesce(sum(ln(ratio)) OVER l, 0)), 4) AS ratio_adjusted
FROM chain LEFT JOIN rolls ON chain.d = rolls.d WINDOW l AS (ORDER BY chain.d DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def futures_adjusted(t: Tables) -> DataFrame:
    c = chain(t)
    out = Fi.adjusted(c, Fi.rolls(c, contracts(t)))
    return out.select("d", "contract", F.round("back_adjusted", 4).alias("back_adjusted"), F.round("ratio_adjusted", 4).alias("ratio_adjusted"))


@query(f"""WITH {CHAIN} SELECT chain.d, round(chain.close / nullif(market.close, 0) - 1, 6) AS basis, CASE WHEN expiry > chain.d THEN round((chain.close / nullif(market.close, 0) - 1) * 365.0 / (expiry - chain.d), 6) END AS annualised FROM chain JOIN market ON chain.d = market.d""")
def futures_basis(t: Tables) -> DataFrame:
    rows = chain(t).join(t.market().select("d", F.col("close").alias("spot")), "d")
    basis, days = ratio("close", "spot") - 1, F.datediff("expiry", "d")
    return rows.select("d", round6(basis).alias("basis"), F.when(days > 0, round6(basis * 365.0 / F.nullif(days, F.lit(0)))).alias("annualised"))


@query("""WITH m AS (SELECT y, q * 3 AS m FROM range(1995, 2003) a(y), range(1, 5) b(q)), f AS (SELECT y, m, make_date(y, m, 1) AS first FROM m)
SELECT CAST(y AS INT) AS y, CAST(m AS INT) AS m, CAST(first + CAST((11 - isodow(first)) % 7 + 14 AS INT) AS DATE) AS expiry FROM f""")
def quarterly_expiries(t: Tables) -> DataFrame:
    rows = t.spark.range(1995, 2003).select(F.col("id").cast("int").alias("y")).withColumn("m", F.explode(F.array(*[F.lit(k) for k in (3, 6, 9, 12)])))
    return rows.select("y", "m", Fi.third_thursday(F.col("y"), F.col("m")).alias("expiry"))


@query(None)
def option_implied_volatility(t: Tables) -> DataFrame:
    """Options on parts: price a fifth of the retail price, strike around it."""
    p = t("part").select("p_partkey", (F.col("p_retailprice") * (0.02 + 0.004 * F.col("p_size"))).alias("price"), F.col("p_retailprice").alias("spot"), (F.col("p_retailprice") * (0.9 + 0.004 * F.col("p_size"))).alias("strike"),
                        (0.1 + F.col("p_size") / 100).alias("years"), F.lit(0.05).alias("rate"), (F.col("p_partkey") % 2 == 0).alias("call"))
    return Fi.implied_volatility(p).select("p_partkey", "call", round6("implied").alias("implied"))


ACTIONS = "act AS (SELECT entity, d, CASE WHEN entity % 2 = 0 THEN 1.0::DOUBLE / 3 ELSE 0.47::DOUBLE END AS factor FROM panel WHERE day(d) = 15 AND month(d) = 6 AND year(d) % 2 = 0)"


@query(f"""WITH {ACTIONS} SELECT panel.entity, panel.d, round(close * exp(coalesce(sum(ln(factor)) OVER (PARTITION BY panel.entity ORDER BY panel.d DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 8) AS adjusted
FROM panel LEFT JOIN act ON panel.entity = act.entity AND panel.d = act.d""")
def adjusted_prices_product(t: Tables) -> DataFrame:
    p = t.panel()
    day = (F.dayofmonth("d") == 15) & (F.month("d") == 6) & (F.year("d") % 2 == 0)
    actions = p.where(day).select("entity", "d", F.when(F.col("entity") % 2 == 0, 1.0 / 3).otherwise(0.47).alias("factor"))
    return Fi.adjusted_prices(p, actions).select("entity", "d", F.round("adjusted", 8).alias("adjusted"))


RATIOS = (0.1, 0.2, 0.25, 0.5, 2.0, 4.0, 5.0, 10.0)


@query(f"""WITH sel AS (SELECT entity, board FROM (SELECT entity, board, row_number() OVER (PARTITION BY entity ORDER BY round(sum(value), 2) DESC, count(*) DESC, board) AS k FROM boards GROUP BY 1, 2) WHERE k = 1),
ch AS (SELECT b.*, lag(b.close) OVER (PARTITION BY b.entity ORDER BY b.d) AS p FROM boards b JOIN sel ON b.entity = sel.entity AND b.board = sel.board WHERE b.close > 0), c AS (SELECT * FROM ch WHERE p > 0 AND abs(ln(close) - ln(p)) > ln(1.5)),
g AS (SELECT *, sum(CASE WHEN q IS NULL OR d - q > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY d) AS episode FROM (SELECT *, lag(d) OVER (PARTITION BY entity ORDER BY d) AS q FROM c)),
e AS (SELECT entity, CAST(episode AS BIGINT) AS episode, min(d) AS first_d, max(d) AS last_d, count(*) AS jumps, array_to_string(list_sort(list(DISTINCT board)), ',') AS boards, arg_min(p, d) AS price_before, arg_max(close, d) AS price_after, round(exp(avg(ln(close / p))), 6) AS factor FROM g GROUP BY 1, 2),
n AS (SELECT *, round(abs(ln(factor) - ln(ratio)), 9) AS error, row_number() OVER (PARTITION BY entity, episode ORDER BY round(abs(ln(factor) - ln(ratio)), 9), ratio) AS k FROM e CROSS JOIN (SELECT unnest([{', '.join(f'CAST({r} AS DOUBLE)' for r in RATIOS)}]) AS ratio))
SELECT substr(sha256(entity || ':' || first_d), 1, 16) AS episode_id, entity, episode, first_d, last_d, jumps, boards, price_before, price_after, factor, ratio AS nearest, round(error, 6) AS ratio_error, CASE WHEN error <= 0.03 THEN 'ratio_candidate' ELSE 'unknown_large_move' END AS kind FROM n WHERE k = 1""")
def corporate_action_episodes(t: Tables) -> DataFrame:
    boards = t.boards()
    selected = board_chain(boards).where("selected").select("entity", "board")
    e = Fi.action_episodes(boards.join(selected, ["entity", "board"]), RATIOS)
    return e.select("episode_id", "entity", "episode", "first_d", "last_d", "jumps", F.array_join("boards", ",").alias("boards"), "price_before", "price_after", "factor", "nearest", round_binary("ratio_error", 6).alias("ratio_error"), "kind")


CURVE = """curve AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS d, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 0.5 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 5 ELSE 10 END AS DOUBLE) AS tenor, round(avg(o_totalprice) / 1e4, 4) AS yield FROM orders GROUP BY 1, 2)"""


def curve(t: Tables) -> DataFrame:
    p = F.col("o_orderpriority")
    tenor = F.when(p == "1-URGENT", 0.5).when(p == "2-HIGH", 1.0).when(p == "3-MEDIUM", 3.0).when(p == "4-NOT SPECIFIED", 5.0).otherwise(10.0)
    return t("orders").groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("d"), tenor.alias("tenor")).agg(F.round(F.avg("o_totalprice") / 1e4, 4).alias("yield"))


GRID = (0.25, 0.75, 2.0, 4.0, 7.0, 15.0)


@query(f"""WITH {CURVE}, g AS (SELECT d, t FROM (SELECT DISTINCT d FROM curve), (SELECT unnest([{', '.join(map(str, GRID))}])::DOUBLE AS t)),
a AS (SELECT g.d, g.t, arg_max(tenor, tenor) AS t0, arg_max(yield, tenor) AS y0 FROM g JOIN curve ON curve.d = g.d AND tenor <= t GROUP BY 1, 2), b AS (SELECT g.d, g.t, arg_min(tenor, tenor) AS t1, arg_min(yield, tenor) AS y1 FROM g JOIN curve ON curve.d = g.d AND tenor >= t GROUP BY 1, 2)
SELECT g.d, g.t AS tenor, round(coalesce(y0 + (y1 - y0) * (g.t - t0) / nullif(t1 - t0, 0), y0, y1), 6) AS yield FROM g LEFT JOIN a ON g.d = a.d AND g.t = a.t LEFT JOIN b ON g.d = b.d AND g.t = b.t""")
def curve_interpolate(t: Tables) -> DataFrame:
    return Fi.interpolate(curve(t), GRID).select("d", "tenor", round6("yield").alias("yield"))


@query(f"""WITH {CURVE}, w AS (SELECT d, max(yield) FILTER (WHERE tenor = 0.5) AS y0, max(yield) FILTER (WHERE tenor = 3) AS y3, max(yield) FILTER (WHERE tenor = 5) AS y5, max(yield) FILTER (WHERE tenor = 10) AS y10 FROM curve GROUP BY 1), s AS (SELECT *, y10 - y3 AS slope, y5 - lag(y5) OVER (ORDER BY d) AS shift FROM w)
SELECT d, round(slope, 6) AS slope, round(2 * y5 - y3 - y10, 6) AS curvature, round(shift, 6) AS shift, round(stddev_samp(shift) OVER (ORDER BY d ROWS 19 PRECEDING), 6) AS shift_volatility, CASE WHEN slope < -0.5 THEN 'inverted' WHEN slope < 0.5 THEN 'flat' ELSE 'normal' END AS regime FROM s""")
def curve_slope_curvature(t: Tables) -> DataFrame:
    w = Window.orderBy("d")
    wide = curve(t).groupBy("d").pivot("tenor", [0.5, 3.0, 5.0, 10.0]).agg(F.max("yield")).toDF("d", "y0", "y3", "y5", "y10")
    s = wide.withColumn("slope", F.col("y10") - F.col("y3")).withColumn("shift", F.col("y5") - F.lag("y5").over(w))
    regime = F.when(F.col("slope") < -0.5, "inverted").when(F.col("slope") < 0.5, "flat").otherwise("normal")
    return s.select("d", round6("slope").alias("slope"), round6(2 * F.col("y5") - F.col("y3") - F.col("y10")).alias("curvature"), round6("shift").alias("shift"), round6(F.stddev_samp("shift").over(W.frame(w, 20))).alias("shift_volatility"), regime.alias("regime"))


@query("""WITH s AS (SELECT *, sum(profit) OVER f AS p4, count(profit) OVER f AS n4, lag(equity) OVER w AS pe, lag(profit, 4) OVER w AS p_year FROM statements WINDOW w AS (PARTITION BY issuer ORDER BY period), f AS (PARTITION BY issuer ORDER BY period ROWS 3 PRECEDING))
SELECT issuer, period, CASE WHEN n4 = 4 THEN round(p4, 2) END AS ttm_profit, round(profit * 4, 2) AS annualised, round(profit / nullif(shares, 0), 6) AS eps, round(equity / nullif(shares, 0), 6) AS bvps,
  round(CASE WHEN n4 = 4 THEN p4 END / nullif((equity + pe) / 2, 0), 6) AS roe, round((profit - p_year) / nullif(abs(p_year), 0), 6) AS growth FROM s""")
def fundamental_ratios(t: Tables) -> DataFrame:
    w = W.by_time("issuer", "period")
    s = t.statements().withColumn("p4", Fi.ttm("profit", ["issuer"], "period")).withColumn("pe", F.lag("equity").over(w)).withColumn("py", F.lag("profit", 4).over(w))
    return s.select("issuer", "period", F.round("p4", 2).alias("ttm_profit"), F.round(F.col("profit") * 4, 2).alias("annualised"), round6(ratio("profit", "shares")).alias("eps"), round6(ratio("equity", "shares")).alias("bvps"),
                    round6(ratio("p4", (F.col("equity") + F.col("pe")) / 2)).alias("roe"), round6(ratio(F.col("profit") - F.col("py"), F.abs("py"))).alias("growth"))


@query("""WITH y AS (SELECT *, round(sum(profit) OVER (PARTITION BY issuer, year(period) ORDER BY period), 2) AS ytd FROM statements) SELECT issuer, period, ytd, round(ytd - coalesce(lag(ytd) OVER (PARTITION BY issuer, year(period) ORDER BY period), 0.0), 2) AS period_value FROM y""")
def ytd_to_period(t: Tables) -> DataFrame:
    w = Window.partitionBy("issuer", F.year("period")).orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    y = t.statements().withColumn("ytd", F.round(F.sum("profit").over(w), 2))
    return y.select("issuer", "period", "ytd", F.round(Fi.period_value("ytd", ["issuer"], "period"), 2).alias("period_value"))


UNITS = {"units": 1.0, "thousands": 1e3, "millions": 1e6}


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'units' WHEN 1 THEN 'thousands' ELSE 'millions' END AS unit, round(p_retailprice * CASE p_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 1000.0 ELSE 1000000.0 END, 2) AS normalized FROM part")
def unit_normalization(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 3
    unit = F.when(k == 0, "units").when(k == 1, "thousands").otherwise("millions")
    factor = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    return t("part").select("p_partkey", unit.alias("unit"), F.round(F.col("p_retailprice") * F.try_element_at(factor, unit), 2).alias("normalized"))


@query("""WITH s AS (SELECT issuer, period, profit, equity, shares, profit / nullif(shares, 0) AS eps, equity / nullif(shares, 0) AS bvps, profit / nullif(equity, 0) AS roe FROM statements)
SELECT issuer, period, round(5000 / nullif(eps, 0), 6) AS pe, round(5000 / nullif(bvps, 0), 6) AS pb, round((roe - 0.03) / (0.12 - 0.03), 6) AS justified_pb, round(eps * 0.5 * 1.03 / (0.12 - 0.03), 4) AS gordon, round(eps * 0.5 * 1.03 / (0.12 - 0.03) / 5000 - 1, 6) AS margin_of_safety FROM s""")
def valuation_multiples(t: Tables) -> DataFrame:
    s = t.statements().withColumn("eps", ratio("profit", "shares")).withColumn("bvps", ratio("equity", "shares")).withColumn("roe", ratio("profit", "equity"))
    value = Fi.gordon(F.col("eps") * 0.5, 0.12, 0.03)
    return s.select("issuer", "period", round6(ratio(F.lit(5000.0), "eps")).alias("pe"), round6(ratio(F.lit(5000.0), "bvps")).alias("pb"), round6(Fi.justified_pb("roe", 0.03, 0.12)).alias("justified_pb"), F.round(value, 4).alias("gordon"), round6(value / 5000 - 1).alias("margin_of_safety"))


@query("""SELECT issuer, profit_change, multiple, round(profit * (1 + profit_change) * multiple / nullif(shares, 0), 4) AS price FROM (SELECT issuer, arg_max(profit, period) AS profit, arg_max(shares, period) AS shares FROM statements GROUP BY 1),
(SELECT unnest([-0.2, 0.0, 0.2])::DOUBLE AS profit_change), (SELECT unnest([4.0, 6.0, 8.0])::DOUBLE AS multiple)""")
def sensitivity_grid(t: Tables) -> DataFrame:
    last = t.statements().groupBy("issuer").agg(F.max_by("profit", "period").alias("profit"), F.max_by("shares", "period").alias("shares"))
    each = lambda *xs: F.explode(F.array(*[F.lit(x) for x in xs]))
    rows = last.withColumn("profit_change", each(-0.2, 0.0, 0.2)).withColumn("multiple", each(4.0, 6.0, 8.0))
    return rows.select("issuer", "profit_change", "multiple", F.round(ratio(F.col("profit") * (1 + F.col("profit_change")) * F.col("multiple"), "shares"), 4).alias("price"))


@query("""WITH s AS (SELECT issuer, period, profit / nullif(equity, 0) AS m FROM statements), e AS (SELECT *, quantile_cont(m, 0.25) OVER h AS q25, quantile_cont(m, 0.5) OVER h AS q50, quantile_cont(m, 0.75) OVER h AS q75, count(m) OVER h AS n, lead(m, 4) OVER (PARTITION BY issuer ORDER BY period) AS later FROM s WINDOW h AS (PARTITION BY issuer ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT issuer, period, n, round(q25, 6) AS conservative, round(q50, 6) AS base, round(q75, 6) AS optimistic, CASE WHEN n < 4 THEN 'forming' WHEN m < q25 THEN 'cheap' WHEN m > q75 THEN 'rich' ELSE 'fair' END AS label, round(later / nullif(m, 0) - 1, 6) AS change_4 FROM e""")
def expanding_valuation_backtest(t: Tables) -> DataFrame:
    w = W.by_time("issuer", "period")
    h = W.before(w)
    s = t.statements().select("issuer", "period", ratio("profit", "equity").alias("m"))
    for q, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")):
        s = s.withColumn(n, F.percentile("m", F.lit(q)).over(h))
    s = s.withColumn("n", F.count("m").over(h)).withColumn("later", F.lead("m", 4).over(w))
    label = F.when(F.col("n") < 4, "forming").when(F.col("m") < F.col("q25"), "cheap").when(F.col("m") > F.col("q75"), "rich").otherwise("fair")
    return s.select("issuer", "period", "n", round6("q25").alias("conservative"), round6("q50").alias("base"), round6("q75").alias("optimistic"), label.alias("label"), round6(ratio("later", "m") - 1).alias("change_4"))


@query("""SELECT p_brand, round(avg(p_retailprice) FILTER (WHERE regexp_matches(p_type, 'STEEL|BRASS')), 4) AS metal, round(avg(p_retailprice) FILTER (WHERE regexp_matches(p_type, '^PROMO')), 4) AS promo, round(avg(p_retailprice) FILTER (WHERE regexp_matches(p_type, '^PROMO')) / avg(p_retailprice), 6) AS promo_ratio FROM part GROUP BY 1""")
def derived_by_family(t: Tables) -> DataFrame:
    pick = lambda p: F.avg(F.when(F.col("p_type").rlike(p), F.col("p_retailprice")))
    return t("part").groupBy("p_brand").agg(F.round(pick("STEEL|BRASS"), 4).alias("metal"), F.round(pick("^PROMO"), 4).alias("promo"), round6(pick("^PROMO") / F.avg("p_retailprice")).alias("promo_ratio"))


@query("""WITH s AS (SELECT issuer, count(*) AS n, count(DISTINCT year(period)) AS years, date_diff('day', max(period), DATE '2001-12-31') AS age, count(*) FILTER (WHERE profit > 0) AS passed, issuer % 2 = 0 AS ifrs, issuer % 3 = 0 AS ras, min(shares) > 0 AS sh, issuer % 5 / 10.0 AS manual, issuer % 4 AS amb, issuer % 7 <> 0 AS stable FROM statements GROUP BY 1),
c AS (SELECT *, least(100, 100 * least(n, 20) / 28.0) AS completeness, greatest(0, 100 - age / 7.0) AS freshness, least(100, n * 8 + years * 4) AS evidence, 100 * passed / greatest(n, 1)::DOUBLE AS consistency, 25 * ifrs::INT + 20 * ras::INT + 20 * sh::INT + 35 * stable::INT AS source, least(60, manual * 40 + amb * 10) AS penalty FROM s),
d AS (SELECT *, greatest(0, least(100, 0.3 * completeness + 0.15 * freshness + 0.2 * evidence + 0.2 * consistency + 0.15 * source - penalty)) AS data FROM c)
SELECT issuer, round(completeness::DOUBLE, 6) AS completeness, round(freshness::DOUBLE, 6) AS freshness, evidence::DOUBLE AS evidence, round(consistency, 6) AS consistency, source::DOUBLE AS source, penalty::DOUBLE AS penalty, round(data::DOUBLE, 1) AS data_confidence, round(data::DOUBLE * 0.85, 1) AS valuation_confidence, round(least(data, evidence)::DOUBLE * 0.8, 1) AS backtest_confidence FROM d""")
def fundamental_confidence(t: Tables) -> DataFrame:
    k = F.col("issuer")
    s = t.statements().groupBy("issuer").agg(F.count("*").alias("n"), F.count_distinct(F.year("period")).alias("history_years"), F.datediff(F.lit("2001-12-31").cast("date"), F.max("period")).alias("age_days"), F.count(F.when(F.col("profit") > 0, 1)).alias("consistency_passed"), (F.min("shares") > 0).alias("has_shares"))
    s = s.withColumns({"key_metrics": F.least("n", F.lit(20)), "total_key_metrics": F.lit(28), "has_ifrs": k % 2 == 0, "has_ras": k % 3 == 0, "consistency_checks": F.col("n"), "validated_releases": F.col("n"), "manual_ratio": k % 5 / 10.0, "ambiguities": k % 4, "stable_methodology": k % 7 != 0})
    out = fundamental_score(s)
    as_double = lambda c: F.col(c).cast("double").alias(c)
    return out.select("issuer", round6("completeness").alias("completeness"), round6("freshness").alias("freshness"), as_double("evidence"), round6("consistency").alias("consistency"), as_double("source"), as_double("penalty"), "data_confidence", "valuation_confidence", "backtest_confidence")


@query("""WITH f AS (SELECT entity, arg_max(close, d) AS price, count(*) AS n, regr_slope(ln(close), CAST(d - DATE '1995-01-01' AS DOUBLE)) * 365 AS growth, sum(CASE WHEN day(d) = 15 THEN close * 0.02 END) AS paid FROM panel GROUP BY 1)
SELECT entity, h AS horizon, round(h * paid / 7 / nullif(price, 0), 6) AS income, round(exp(growth * h) - 1, 6) AS growth_part, round(h * paid / 7 / nullif(price, 0) + exp(growth * h) - 1, 6) AS expected FROM f, (SELECT unnest([1, 3, 5]) AS h)""")
def expected_return_decomposition(t: Tables) -> DataFrame:
    days = F.datediff("d", F.lit("1995-01-01").cast("date")).cast("double")
    f = t.panel().groupBy("entity").agg(F.max_by("close", "d").alias("price"), (F.regr_slope(F.log("close"), days) * 365).alias("growth"), F.sum(F.when(F.dayofmonth("d") == 15, F.col("close") * 0.02)).alias("paid"))
    f = f.withColumn("horizon", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5))))
    income, growth = ratio(F.col("horizon") * F.col("paid") / 7, "price"), F.exp(F.col("growth") * F.col("horizon")) - 1
    return f.select("entity", "horizon", round6(income).alias("income"), round6(growth).alias("growth_part"), round6(income + growth).alias("expected"))


@query("""WITH x AS (SELECT ret.entity, ret.r, mret.r AS m, ntile(4) OVER (PARTITION BY ret.entity ORDER BY ret.d) AS chunk FROM ret JOIN mret ON ret.d = mret.d WHERE ret.r IS NOT NULL AND mret.r IS NOT NULL),
c AS (SELECT entity, chunk, regr_slope(r, m) AS b FROM x GROUP BY 1, 2), a AS (SELECT entity, regr_slope(r, m) AS beta, count(*) AS n FROM x GROUP BY 1)
SELECT a.entity, n, round(any_value(beta), 5) AS beta, count(*) FILTER (WHERE sign(b) = sign(beta)) AS same_sign, count(*) FILTER (WHERE sign(b) = sign(beta)) = 4 AS stable FROM a JOIN c ON a.entity = c.entity GROUP BY 1, 2""")
def macro_sensitivity(t: Tables) -> DataFrame:
    m = returns(t.market().withColumn("entity", F.lit(0))).select("d", F.col("r").alias("m")).where("m IS NOT NULL")
    x = returns(t.panel()).where("r IS NOT NULL").join(m, "d").withColumn("chunk", F.ntile(4).over(W.by_time("entity", "d")))
    c = x.groupBy("entity", "chunk").agg(F.regr_slope("r", "m").alias("b"))
    a = x.groupBy("entity").agg(F.regr_slope("r", "m").alias("beta"), F.count("*").alias("n"))
    same = F.count(F.when(F.signum("b") == F.signum("beta"), 1))
    return a.join(c, "entity").groupBy("entity", "n").agg(F.round(F.any_value("beta"), 5).alias("beta"), same.alias("same_sign"), (same == 4).alias("stable"))


@query("""WITH o AS (SELECT series, available, value, vintage FROM (SELECT *, row_number() OVER (PARTITION BY series, available ORDER BY vintage DESC) AS n FROM observations) WHERE n = 1), s AS (SELECT d FROM market),
g AS (SELECT s.d, o.series FROM s CROSS JOIN (SELECT DISTINCT series FROM observations) o), j AS (SELECT g.d, g.series, o.value FROM g ASOF LEFT JOIN o ON g.series = o.series AND g.d >= o.available)
SELECT d, h AS horizon, count(value) AS known, round(max(value) FILTER (WHERE series = '1-URGENT'), 2) AS urgent, round(max(value) FILTER (WHERE series = '5-LOW'), 2) AS low FROM j, (SELECT unnest([5, 20]) AS h) GROUP BY 1, 2""")
def macro_snapshots(t: Tables) -> DataFrame:
    from chronoframe.operators.joins import asof
    from chronoframe.queries.joins import _obs

    grid = t.market().select("d").join(F.broadcast(t.observations().select("series").distinct()))  # sessions by series
    j = asof(grid, _obs(t), ["series"], "d", "available", ["value"], bucket="quarter").withColumn("horizon", F.explode(F.array(F.lit(5), F.lit(20))))
    pick = lambda s: F.round(F.max(F.when(F.col("series") == s, F.col("value"))), 2)
    return j.groupBy("d", "horizon").agg(F.count("value").alias("known"), pick("1-URGENT").alias("urgent"), pick("5-LOW").alias("low"))


@query("""WITH p AS (SELECT l_suppkey AS entity, o_orderkey, max(CAST(o_orderdate AS DATE)) AS published, max(o_totalprice) / 1000 AS dividend FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2)
SELECT p.entity, p.o_orderkey, q.d, round(p.dividend / nullif(q.close, 0), 6) AS yield FROM p ASOF JOIN panel q ON p.entity = q.entity AND p.published <= q.d""")
def dividend_yield_at_publication(t: Tables) -> DataFrame:
    from chronoframe.operators.joins import asof

    p = t("orders").where("o_orderpriority = '1-URGENT'").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("l_suppkey").alias("entity"), "o_orderkey")
    p = p.agg(F.max(F.to_date("o_orderdate")).alias("published"), (F.max("o_totalprice") / 1000).alias("dividend"))
    out = asof(p, t.panel().select("entity", "d", "close"), ["entity"], "published", "d", ["close"], inner=True, forward=True)
    return out.select("entity", "o_orderkey", F.col("asof_d").alias("d"), round6(ratio("dividend", "close")).alias("yield"))
