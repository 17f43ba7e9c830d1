"""Price-panel operators: canonical chains, returns, liquidity, breadth, state, features, labels."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions.expr import count_if, ratio, share
from chronoframe.operators import rules as R
from chronoframe.operators import windows as W


def canonical(prices: DataFrame, segments: DataFrame) -> DataFrame:
    """One price row an entity and day: of the segments whose closed interval holds the day, the one
    of highest priority, then the first board.  prices(entity, board, d, ...), segments(entity,
    board, valid_from, valid_to, priority)."""
    joined = prices.join(segments, ["entity", "board"]).where((F.col("d") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("d") <= F.col("valid_to"))))
    return W.latest(joined, ["entity", "d"], [F.col("priority").desc(), F.col("board")])


def board_chain(boards: DataFrame) -> DataFrame:
    """Board rollup with the selected chain: most value, then most observations, then board name."""
    rows = boards.groupBy("entity", "board").agg(F.count("*").alias("observations"), F.round(F.sum("value"), 2).alias("total_value"), F.min("d").alias("first_d"), F.max("d").alias("last_d"))
    w = Window.partitionBy("entity").orderBy(F.col("total_value").desc_nulls_last(), F.col("observations").desc(), "board")
    return rows.withColumn("selected", F.row_number().over(w) == 1)


def total_returns(prices: DataFrame, dividends: DataFrame | None = None) -> DataFrame:
    """Price, log, dividend and total return with a compounded index that starts at 1.

    The previous close is the last non-null one; a zero one gives no return.  A dividend counts only
    on a trading day.  prices(entity, d, close), dividends(entity, d, dividend), or a column dividend of
    prices.
    """
    w = W.by_time("entity", "d")
    if dividends is not None:
        prices = prices.join(dividends.groupBy("entity", "d").agg(F.sum("dividend").alias("dividend")), ["entity", "d"], "left")
    rows = prices.withColumn("prev", F.last("close", True).over(W.before(w)))
    rows = rows.withColumn("price_return", ratio("close", "prev") - 1)
    rows = rows.withColumn("log_return", F.when((F.col("close") > 0) & (F.col("prev") > 0), F.log(F.col("close") / F.col("prev"))))
    rows = rows.withColumn("dividend_return", F.when(F.col("price_return").isNotNull(), F.coalesce(ratio("dividend", "prev"), F.lit(0.0))))
    rows = rows.withColumn("total_return", F.col("price_return") + F.col("dividend_return"))
    growth = F.log(F.when(F.col("total_return") > -1, 1 + F.col("total_return")))
    return rows.withColumn("total_return_index", F.exp(F.coalesce(F.sum(growth).over(W.so_far(w)), F.lit(0.0))))


def returns(prices: DataFrame, close: str = "close", keys: Sequence[str] = ("entity",), name: str = "r") -> DataFrame:
    """One-row return on the row before."""
    return prices.withColumn(name, ratio(close, F.lag(close).over(Window.partitionBy(*keys).orderBy("d"))) - 1)


def liquidity(prices: DataFrame) -> DataFrame:
    """Robust return, turnover means, volume and trades against the twenty rows before, Amihud by value
    and by volume, value over volatility, daily percentiles and the regime (0.8 and more high, under
    0.2 low).  prices(entity, d, close, value, volume, and trades where they are known).

    A move by a factor of 100 or more, and one from or to a close that isn't over zero, is no return.
    """
    w = W.by_time("entity", "d")
    prices = prices if "trades" in prices.columns else prices.withColumn("trades", F.lit(None).cast("long"))
    before = F.lag("close").over(w)
    move = F.when((F.col("close") > 0) & (before > 0), F.log(F.col("close")) - F.log(before))
    rows = prices.withColumn("r", move).withColumn("r", F.when(F.abs("r") < math.log(100), F.exp("r") - 1))
    rows = rows.withColumns({f"turnover_{n}": F.avg("value").over(W.frame(w, n)) for n in (5, 20, 60, 120, 250)})
    rows = rows.withColumns({"volume_20": F.avg("volume").over(W.frame(w, 20)), "trades_20": F.avg("trades").over(W.frame(w, 20)), "_v": F.avg("volume").over(W.frame(w, 20, 20)),
                             "_n": F.avg("trades").over(W.frame(w, 20, 20)), "_sd": F.stddev_samp("r").over(W.frame(w, 20))})
    rows = rows.withColumns({"amihud": ratio(F.abs("r"), "value"), "volume_impact": ratio(F.abs("r"), "volume"), "value_per_trade": ratio("value", "trades"), "volume_per_trade": ratio("volume", "trades"),
                             "zero_volume": F.coalesce(F.col("volume"), F.lit(0.0)) == 0, "volume_acceleration": ratio("volume_20", "_v") - 1, "trades_acceleration": ratio("trades_20", "_n") - 1,
                             "value_over_volatility": ratio("value", "_sd")}).drop("_v", "_n", "_sd")
    rank = lambda c: F.percent_rank().over(Window.partitionBy("d").orderBy(F.col(c).asc_nulls_last()))
    rows = rows.withColumns({"liquidity_percentile": rank("turnover_20"), "value_percentile": rank("value"), "volume_percentile": rank("volume")})
    regime = F.when(F.col("liquidity_percentile") >= 0.8, "high").when(F.col("liquidity_percentile") < 0.2, "low").otherwise("normal")
    return rows.withColumn("liquidity_regime", regime)


def breadth(prices: DataFrame, sma: int = 20) -> DataFrame:
    """Daily counts of advancing, declining and unchanged entities, shares above the mean, new highs
    and lows, value-weighted return, cross-section dispersion."""
    w = W.by_time("entity", "d")
    rows = returns(prices).withColumn("mean", F.avg("close").over(W.frame(w, sma))).withColumn("n", F.count("close").over(W.frame(w, sma)))
    rows = rows.withColumn("high_so_far", F.max("close").over(W.frame(w, sma))).withColumn("low_so_far", F.min("close").over(W.frame(w, sma)))
    full = F.col("n") >= sma
    out = rows.groupBy("d").agg(
        F.count("*").alias("entities"), count_if(F.col("r") > 0).alias("advancing"), count_if(F.col("r") < 0).alias("declining"),
        count_if(F.col("r") == 0).alias("unchanged"), share(F.when(full, F.col("close") > F.col("mean"))).alias("above_mean"),
        count_if(full & (F.col("close") >= F.col("high_so_far"))).alias("new_highs"), count_if(full & (F.col("close") <= F.col("low_so_far"))).alias("new_lows"),
        (F.sum(F.when(F.col("r").isNotNull(), F.col("r") * F.col("value"))) / F.sum(F.when(F.col("r").isNotNull(), F.col("value")))).alias("weighted_return"),
        F.avg("r").alias("mean_return"), F.median("r").alias("median_return"), F.stddev_samp("r").alias("dispersion"))
    return out.withColumn("ad_ratio", ratio(F.col("advancing").cast("double"), F.col("declining").cast("double")))


def advance_decline_line(daily: DataFrame) -> DataFrame:
    """Running sum of advances less declines over the calendar (a row a day)."""
    w = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("ad_line", F.sum(F.col("advancing") - F.col("declining")).over(w))


def zscore_before(value: str, w, rows: int = 249) -> Column:
    """z-score against the rows before the current one."""
    past = w.rowsBetween(-rows, -1)
    return ratio(F.col(value) - F.avg(value).over(past), F.stddev_samp(value).over(past))


def market_state(prices: DataFrame) -> DataFrame:
    """The market by day: net breadth, turnover and dispersion against the 249 days before, trend (share
    of entities above their 50-row mean, as it forms, from -1 to 1), risk appetite (turnover of rising
    less falling entities), the state and what it was read from as JSON.  prices(entity, d, close, value)."""
    w = W.by_time("entity", "d")
    rows = prices.withColumn("_p", F.lag("close").over(w)).withColumn("_m", F.avg("close").over(W.frame(w, 50)))
    up, down = F.col("close") > F.col("_p"), F.col("close") < F.col("_p")
    day = rows.groupBy("d").agg(F.count("*").alias("n"), count_if(up).alias("advancing"), count_if(down).alias("declining"), count_if(F.col("close") > F.col("_m")).alias("_above"), F.stddev_samp(ratio("close", "_p") - 1).alias("_sd"),
                                F.sum("value").alias("turnover"), F.sum(F.when(up, F.col("value"))).alias("_up"), F.sum(F.when(down, F.col("value"))).alias("_down"))
    n = F.col("n").cast("double")
    day = day.withColumns({"breadth": ratio((F.col("advancing") - F.col("declining")).cast("double"), n), "risk_appetite": ratio(F.col("_up") - F.col("_down"), "turnover"),
                           "trend": (ratio(F.col("_above").cast("double"), n) - 0.5) * 2, "dispersion": -F.col("_sd"), "liquidity": F.log(F.when(F.col("turnover") > 0, F.col("turnover")))})
    line = Window.orderBy("d")  # a row a day
    day = day.withColumns({"breadth_z": zscore_before("breadth", line), "liquidity_z": zscore_before("liquidity", line), "dispersion_z": zscore_before("dispersion", line)})
    context = F.to_json(F.struct("breadth", "advancing", "declining", "turnover", "trend", "risk_appetite"))
    return day.withColumn("state", R.label(R.MARKET_STATE, "mixed")).withColumn("context", context).drop("_above", "_sd", "_up", "_down", "liquidity")


def forward(prices: DataFrame, horizons: Sequence[int], close: str = "close") -> DataFrame:
    """Forward return, worst drawdown and best gain on the path t..t+h, null where t+h is unknown."""
    w = W.by_time("entity", "d")
    rows = prices
    for h in horizons:
        path = w.rowsBetween(0, h)
        rows = rows.withColumn("_end", F.lead(close, h).over(w)).withColumn("_path", F.collect_list(close).over(path))
        known = F.col("_end").isNotNull()
        rows = rows.withColumn(f"forward_return_{h}", ratio("_end", close) - 1)
        rows = rows.withColumn(f"forward_drawdown_{h}", F.when(known, W.drawdown_of(F.col("_path"))))
        rows = rows.withColumn(f"forward_gain_{h}", F.when(known, F.array_max("_path") / F.col(close) - 1)).drop("_end", "_path")
    return rows


def path_facts(df: DataFrame, path: str) -> DataFrame:
    """Adds what path rules ask for, from an array of cumulative returns t+1..t+h: terminal, low,
    high, sd (population deviation of the steps), ups (share of steps that don't fall)."""
    rows = df.withColumn("_s", F.expr(f"transform({path}, (x, i) -> x - if(i = 0, 0D, {path}[i - 1]))"))
    rows = rows.withColumn("_m", F.expr("aggregate(_s, 0D, (a, x) -> a + x) / size(_s)"))
    rows = rows.withColumn("sd", F.sqrt(F.expr("aggregate(_s, 0D, (a, x) -> a + (x - _m) * (x - _m)) / size(_s)")))
    rows = rows.withColumn("ups", F.size(F.filter("_s", lambda x: x >= 0)) / F.size("_s"))
    return rows.withColumn("terminal", F.element_at(path, -1)).withColumn("low", F.array_min(path)).withColumn("high", F.array_max(path)).drop("_s", "_m")


def membership(prices: DataFrame, lifecycles: DataFrame, floor: float = 0.0, lookback: int = 20) -> DataFrame:
    """Who could be traded on each day, judged by the days before: one row an entity and day with
    liquidity (median value of the entity's board over up to `lookback` rows before, one at least) and
    eligible (within a lifecycle, close over zero, liquidity at the floor or over it, unknown as 0).

    prices(entity, board, d, close, value), lifecycles(entity, board, valid_from, valid_to, is_primary),
    an open end null.  Of an entity's boards the primary one counts, then the more liquid, then the name.
    """
    past = Window.partitionBy("entity", "board").orderBy("d").rowsBetween(-lookback, -1)
    rows = prices.withColumn("liquidity", F.percentile("value", F.lit(0.5)).over(past)).join(lifecycles, ["entity", "board"], "left")
    live = F.coalesce((F.col("d") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("d") <= F.col("valid_to"))), F.lit(False))
    rows = rows.withColumn("eligible", live & F.coalesce(F.col("close") > 0, F.lit(False)) & (F.coalesce("liquidity", F.lit(0.0)) >= floor))
    return W.latest(rows, ["d", "entity"], [F.coalesce("is_primary", F.lit(False)).desc(), F.col("liquidity").desc_nulls_last(), F.col("board")])
