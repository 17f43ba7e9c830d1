"""Derivatives, rates, corporate actions, fundamentals and valuation."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions.expr import col, ratio
from chronoframe.functions.workers import ship
from chronoframe.operators import windows as W


#: What may decide that the next contract takes over.
ROLL_RULES = ("expiry", "volume", "open_interest", "combined")


def continuous(contracts: DataFrame, roll_days: int, rule: str = "expiry") -> DataFrame:
    """One contract a day: the nearest by expiry, or the next one where the rule says so: within
    roll_days of the expiry, with more volume, with more open interest, or (combined) within roll_days or
    with more of both; unknown ones count 0.  Adds front and next to the chosen row.
    contracts(d, contract, expiry, close, volume, open_interest)."""
    if rule not in ROLL_RULES:
        raise ValueError(f"rule must be one of {', '.join(ROLL_RULES)}")
    live = contracts.where(F.col("d") <= F.col("expiry"))
    w = Window.partitionBy("d").orderBy("expiry", "contract")
    near = live.select("d", F.struct(*[c for c in live.columns if c != "d"]).alias("_c"), F.row_number().over(w).alias("_n")).where("_n <= 2")
    day = near.groupBy("d").agg(F.max(F.when(F.col("_n") == 1, F.col("_c"))).alias("f"), F.max(F.when(F.col("_n") == 2, F.col("_c"))).alias("s"))
    more = lambda c: F.coalesce(F.col(f"s.{c}"), F.lit(0)) > F.coalesce(F.col(f"f.{c}"), F.lit(0))
    soon = F.datediff("f.expiry", "d") <= roll_days
    turn = {"expiry": lambda: soon, "volume": lambda: more("volume"), "open_interest": lambda: more("open_interest"), "combined": lambda: soon | (more("volume") & more("open_interest"))}[rule]()
    chosen = F.when(F.col("s").isNotNull() & turn, F.col("s")).otherwise(F.col("f"))
    return day.select("d", chosen.alias("_c"), F.col("f.contract").alias("front"), F.col("s.contract").alias("next")).select("d", "_c.*", "front", "next")


def crossovers(contracts: DataFrame, pairs: DataFrame, rule: str = "liquidity", days_before: int = 5) -> DataFrame:
    """For pairs(old, new) the first common day on which the new contract has more volume (liquidity) or
    open interest, or the old one is days_before of its expiry or nearer; the last common day where none
    is.  Columns old, new, d, old_close, new_close, difference, ratio."""
    old = contracts.select(F.col("contract").alias("old"), "d", *[F.col(c).alias(f"old_{c}") for c in ("expiry", "close", "volume", "open_interest")])
    new = contracts.select(F.col("contract").alias("new"), "d", *[F.col(c).alias(f"new_{c}") for c in ("close", "volume", "open_interest")])
    both = pairs.join(old, "old").join(new, ["new", "d"])
    when = {"liquidity": lambda: F.col("new_volume") > F.col("old_volume"), "open_interest": lambda: F.col("new_open_interest") > F.col("old_open_interest"), "expiry": lambda: F.datediff("old_expiry", "d") <= days_before}[rule]()
    row = F.struct("d", "old_close", "new_close")
    out = both.groupBy("old", "new").agg(F.coalesce(F.min(F.when(when, row)), F.max(row)).alias("r")).select("old", "new", "r.*")
    return out.withColumn("difference", F.col("new_close") - F.col("old_close")).withColumn("ratio", ratio("new_close", "old_close"))


def rolls(chain: DataFrame, contracts: DataFrame) -> DataFrame:
    """Days where the contract changes, with the old and the new contract's close on that day."""
    w = Window.orderBy("d")
    change = chain.withColumn("old", F.lag("contract").over(w)).where("old <> contract").select("d", "old", F.col("contract").alias("new"), F.col("close").alias("new_close"))
    old = contracts.select("d", F.col("contract").alias("old"), F.col("close").alias("old_close"))
    return change.join(old, ["d", "old"], "left").withColumn("difference", F.col("new_close") - F.col("old_close")).withColumn("ratio", ratio("new_close", "old_close"))


def adjusted(chain: DataFrame, roll_rows: DataFrame) -> DataFrame:
    """Back-adjusted (plus all later differences) and ratio-adjusted (times all later ratios) closes."""
    later = Window.orderBy(F.col("d").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = chain.join(roll_rows.select("d", "difference", "ratio"), "d", "left")
    add = F.coalesce(F.sum("difference").over(later), F.lit(0.0))
    by = F.exp(F.coalesce(F.sum(F.log("ratio")).over(later), F.lit(0.0)))
    return rows.withColumn("back_adjusted", F.col("close") + add).withColumn("ratio_adjusted", F.col("close") * by).drop("difference", "ratio")


def third_thursday(year: Column, month: Column) -> Column:
    first = F.make_date(year, month, F.lit(1))
    return F.date_add(F.next_day(F.date_sub(first, 1), "THU"), 14)


def _erf_price(spot, strike, years, rate, sigma, call):
    import numpy as np
    from math import erf, sqrt

    n = np.vectorize(lambda x: 0.5 * (1 + erf(x / sqrt(2))))
    d1 = (np.log(spot / strike) + (rate + sigma * sigma / 2) * years) / (sigma * np.sqrt(years))
    d2 = d1 - sigma * np.sqrt(years)
    c = spot * n(d1) - strike * np.exp(-rate * years) * n(d2)
    return np.where(call, c, c - spot + strike * np.exp(-rate * years))


def implied_volatility(df: DataFrame, steps: int = 100) -> DataFrame:
    """Adds `implied` to rows (price, spot, strike, years, rate, call) by bisection on [1e-6, 5], all
    rows of a batch at once; null outside the arbitrage bounds.  There is no error function among the
    built-in ones, so this runs over Arrow batches."""
    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for b in batches:
            x = {k: b[k].to_numpy(dtype=float) for k in ("price", "spot", "strike", "years", "rate")}
            call = b["call"].to_numpy(dtype=bool)
            low, high = np.full(len(b), 1e-6), np.full(len(b), 5.0)
            for _ in range(steps):
                mid = (low + high) / 2
                over = _erf_price(x["spot"], x["strike"], x["years"], x["rate"], mid, call) > x["price"]
                high, low = np.where(over, mid, high), np.where(over, low, mid)
            floor = np.maximum(np.where(call, x["spot"] - x["strike"], x["strike"] - x["spot"]), 0)
            sound = (x["price"] >= floor) & (x["price"] <= np.where(call, x["spot"], x["strike"])) & (x["years"] > 0) & (x["price"] > 0)
            yield b.assign(implied=np.where(sound, (low + high) / 2, np.nan))

    from pyspark.sql.types import DoubleType, StructField, StructType

    out = df.mapInPandas(run, StructType([*df.schema.fields, StructField("implied", DoubleType())]))
    return out.withColumn("implied", F.nanvl("implied", F.lit(None).cast("double")))


def adjusted_prices(prices: DataFrame, actions: DataFrame) -> DataFrame:
    """Close times the product of the factors of all later actions: one reverse running sum of logs.
    actions(entity, d, factor); the factor of a day holds for the days before it."""
    later = Window.partitionBy("entity").orderBy(F.col("d").desc()).rowsBetween(Window.unboundedPreceding, -1)
    factor = actions.groupBy("entity", "d").agg(F.sum(F.log("factor")).alias("lf"))
    rows = prices.join(factor, ["entity", "d"], "left")
    return rows.withColumn("adjusted", F.col("close") * F.exp(F.coalesce(F.sum("lf").over(later), F.lit(0.0)))).drop("lf")


def interpolate(curve: DataFrame, tenors: Sequence[float]) -> DataFrame:
    """Yields at fixed tenors, linear between the curve's points, flat beyond them.
    curve(d, tenor, yield)."""
    points = F.array_sort(F.collect_list(F.struct("tenor", "yield"))).alias("p")
    rows = curve.groupBy("d").agg(points).withColumn("t", F.explode(F.array(*[F.lit(float(x)) for x in tenors])))
    below = F.try_element_at(F.filter("p", lambda x: x["tenor"] <= F.col("t")), F.lit(-1))
    above = F.try_element_at(F.filter("p", lambda x: x["tenor"] >= F.col("t")), F.lit(1))
    rows = rows.withColumn("a", below).withColumn("b", above)
    between = F.col("a.yield") + (F.col("b.yield") - F.col("a.yield")) * ratio(F.col("t") - F.col("a.tenor"), F.col("b.tenor") - F.col("a.tenor"))
    return rows.select("d", F.col("t").alias("tenor"), F.coalesce(between, F.col("a.yield"), F.col("b.yield")).alias("yield"))


def ttm(value: str, entity: Sequence[str], period: str) -> Column:
    """Sum of the last four periods, null unless all four are there."""
    w = W.frame(W.by_time(entity, period), 4)
    return W.rolling(F.sum(value), F.col(value), w, 4)


def period_value(value: str, entity: Sequence[str], period: str) -> Column:
    """Year-to-date to period: less the period before in the same year; the first period as it is."""
    w = Window.partitionBy(*entity, F.year(period)).orderBy(period)
    return F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0.0))


def justified_pb(roe: Column | str, growth: float, cost: float) -> Column:
    return F.lit(None).cast("double") if cost <= growth else (col(roe) - growth) / F.lit(cost - growth)


def gordon(dividend: Column | str, cost: float, growth: float) -> Column:
    return F.lit(None).cast("double") if cost <= growth else col(dividend) * F.lit(1 + growth) / F.lit(cost - growth)


def action_episodes(prices: DataFrame, ratios: Sequence[float], jump: float = 1.5, gap_days: int = 5, close_to: float = 0.03) -> DataFrame:
    """Runs of price moves by a factor over `jump` either way that may be corporate actions, new ones after
    gap_days calendar days without one: first and last day, number, boards, the price before and after, the
    geometric mean factor and the nearest of the known ratios by logarithm (ties: the smaller), with
    ratio_error and what it looks like.  prices(entity, board, d, close), one board a day; closes that
    aren't over zero are left out.  Nothing here confirms an action."""
    w = W.by_time("entity", "d")
    rows = prices.where("close > 0").withColumn("_p", F.lag("close").over(w)).where(F.abs(F.log("close") - F.log("_p")) > math.log(jump))
    rows = W.episodes(rows, ["entity"], "d", F.datediff("d", F.lag("d").over(w)) > gap_days)
    e = rows.groupBy("entity", "episode").agg(F.min("d").alias("first_d"), F.max("d").alias("last_d"), F.count("*").alias("jumps"), F.array_sort(F.collect_set("board")).alias("boards"), F.min_by("_p", "d").alias("price_before"),
                                              F.max_by("close", "d").alias("price_after"), F.round(F.exp(F.avg(F.log(F.col("close") / F.col("_p")))), 6).alias("factor"))
    best = F.array_min(F.array(*[F.struct(F.round(F.abs(F.log("factor") - F.log(F.lit(float(r)))), 9).alias("x"), F.lit(float(r)).alias("r")) for r in ratios]))
    e = e.withColumn("_b", best).withColumns({"nearest": F.col("_b.r"), "ratio_error": F.col("_b.x")}).drop("_b")
    kind = F.when(F.col("ratio_error") <= close_to, "ratio_candidate").otherwise("unknown_large_move")
    return e.withColumns({"kind": kind, "episode_id": F.substring(F.sha2(F.concat_ws(":", F.col("entity").cast("string"), F.col("first_d").cast("string")), 256), 1, 16)})
