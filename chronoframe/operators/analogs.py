"""Similarity and path analytics: scaling, distances, spaced choices, weighted quantiles, barriers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions.expr import clip, ratio
from chronoframe.operators import rules as R
from chronoframe.operators import windows as W


def spaced_top_k(df: DataFrame, keys: Sequence[str], distance: str, position: str, spacing: int, k: int) -> DataFrame:
    """The k nearest rows of each key, taken in order of (distance, position), skipping rows within
    `spacing` positions of one already taken; positions are distinct by key.

    A row taken rules out 2 * spacing - 2 others at most, so the k-th stands among the first
    (k - 1) * (2 * spacing - 1) + 1: a key's array holds that many, however long its series."""
    order = Window.partitionBy(*keys).orderBy(F.col(distance).asc_nulls_last(), position)
    near = df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= (k - 1) * (2 * spacing - 1) + 1)
    items = F.array_sort(F.collect_list(F.struct("_n", F.col(distance).alias("distance"), F.col(position).alias("position"))))
    rows = near.groupBy(*keys).agg(items.alias("items"))
    none = F.slice("items", 1, 0)
    taken = F.aggregate("items", none, lambda acc, x: F.when((F.size(acc) < k) & F.forall(acc, lambda y: F.abs(y["position"] - x["position"]) >= spacing), F.concat(acc, F.array(x))).otherwise(acc))
    return rows.select(*keys, F.posexplode(taken).alias("rank", "item")).select(*keys, (F.col("rank") + 1).alias("rank"), F.col("item.position").alias(position), F.col("item.distance").alias(distance))


def robust_scaled(df: DataFrame, columns: Sequence[str], train: Column, limit: float = 12.0) -> DataFrame:
    """(x - median) / IQR with the statistics of the train rows, clipped; an unknown value counts as the
    median, an IQR that is zero or unknown as 1."""
    stats = df.where(train).agg(*[s for c in columns for s in (F.percentile(c, 0.5).alias(f"_m_{c}"), (F.percentile(c, 0.75) - F.percentile(c, 0.25)).alias(f"_q_{c}"))])
    out = df.join(F.broadcast(stats))
    for c in columns:
        scale = F.coalesce(F.nullif(F.col(f"_q_{c}"), F.lit(0.0)), F.lit(1.0))
        out = out.withColumn(c, clip((F.coalesce(F.col(c), F.col(f"_m_{c}")) - F.col(f"_m_{c}")) / scale, -limit, limit))
    return out.select(*df.columns)


def z_scaled(df: DataFrame, columns: Sequence[str], train: Column) -> DataFrame:
    stats = df.where(train).agg(*[s for c in columns for s in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_q_{c}"))])
    out = df.join(F.broadcast(stats))
    for c in columns:
        out = out.withColumn(c, ratio(F.col(c) - F.col(f"_m_{c}"), f"_q_{c}"))
    return out.select(*df.columns)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str, b: str) -> Column:
    return ratio(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def rms_distance(a: Column | str, b: Column | str) -> Column:
    """Root mean square difference of two arrays of equal length."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x) / F.size(a))


def family_distance(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean of the families' distances; a missing family's weight goes to the others."""
    zero = F.lit(0.0)
    top = sum((F.coalesce(parts[k] * w, zero) for k, w in weights.items()), zero)
    under = sum((F.when(parts[k].isNotNull(), F.lit(w)).otherwise(zero) for k, w in weights.items()), zero)
    return ratio(top, under)


def weighted_quantile(df: DataFrame, keys: Sequence[str], value: str, weight: str, quantiles: Sequence[float]) -> DataFrame:
    """Smallest value whose cumulative weight share reaches q; no interpolation."""
    w = Window.partitionBy(*keys)
    part = df.withColumn("_c", F.sum(weight).over(w.orderBy(value).rangeBetween(Window.unboundedPreceding, 0))).withColumn("_t", F.sum(weight).over(w))
    return part.groupBy(*keys).agg(*[F.min(F.when(F.col("_c") >= q * F.col("_t") - 1e-12, F.col(value))).alias(f"q{round(q * 100):02d}") for q in quantiles])


def effective_sample(weight: str) -> Column:
    """Aggregate: (sum w)^2 / sum w^2."""
    return ratio(F.sum(weight) * F.sum(weight), F.sum(F.col(weight) * F.col(weight)))


def first_passage(path: Column, upper: float, lower: float) -> Column:
    """(side, session) of the first value at or beyond a barrier; a tie in one session is lower."""
    up = F.array_position(F.transform(path, lambda x: x >= upper), True)
    down = F.array_position(F.transform(path, lambda x: x <= lower), True)
    side = F.when((down > 0) & ((up == 0) | (down <= up)), "lower").when(up > 0, "upper").otherwise("neither")
    return F.struct(side.alias("side"), F.when((up > 0) | (down > 0), F.least(F.when(up > 0, up), F.when(down > 0, down))).cast("int").alias("session"))


def nearest_representative(days: DataFrame, representatives: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Each day with its nearest representative's position (ties: the earlier): two passes over one
    order, one looking back and one ahead."""
    both = days.select(*keys, F.col(position).alias("_p"), F.lit(None).cast("long").alias("_rep"), F.lit(1).alias("_day"))
    both = both.unionByName(representatives.select(*keys, F.col(position).alias("_p"), F.col(position).cast("long").alias("_rep"), F.lit(0).alias("_day")))
    w = Window.partitionBy(*keys)
    back = F.last("_rep", True).over(w.orderBy("_p", "_day").rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.last("_rep", True).over(w.orderBy(F.col("_p").desc(), "_day").rowsBetween(Window.unboundedPreceding, 0))
    rows = both.withColumn("_a", back).withColumn("_b", ahead).where("_day = 1")
    near = F.when(F.col("_a").isNull(), F.col("_b")).when(F.col("_b").isNull(), F.col("_a")).when(F.col("_p") - F.col("_a") <= F.col("_b") - F.col("_p"), F.col("_a")).otherwise(F.col("_b"))
    return rows.select(*keys, F.col("_p").alias(position), near.alias("representative"))


def compatibility(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Share of the regime dimensions known on both sides that agree; null if none is known."""
    known = [a[k].isNotNull() & b[k].isNotNull() for k in a]
    same = sum((F.when(n & (a[k] == b[k]), 1).otherwise(0) for k, n in zip(a, known)), F.lit(0))
    return ratio(same, sum((F.when(n, 1).otherwise(0) for n in known), F.lit(0)))


def regime_dimensions(facts: DataFrame, order: str, keys: Sequence[str]) -> DataFrame:
    """Adds market_trend, volatility and rates to facts (ret60, drawdown, vol, level), each judged by the
    quantiles and the deviation of the values up to its own row; for calendar-sized tables."""
    w = Window.partitionBy(*keys).orderBy(order)
    h = w.rowsBetween(Window.unboundedPreceding, 0)
    q = facts.withColumns({f"q{x}": F.percentile("vol", F.lit(x / 100)).over(h) for x in (25, 75, 90)} | {"n": F.count("vol").over(h)})
    q = q.withColumns({"market_trend": R.label(R.MARKET_TREND, "strong_bull"), "volatility": R.label(R.VOLATILITY_REGIME, "normal")})
    q = q.withColumns({"n": F.count("level").over(h), "change": F.col("level") - F.lag("level", 20).over(w), "meaningful": F.nullif(F.stddev_samp("level").over(h), F.lit(0.0)) * 0.1, "q75": F.percentile("level", F.lit(0.75)).over(h)})
    return q.withColumn("rates", R.label(R.RATES_REGIME, "stable_normal")).drop("q25", "q75", "q90", "n", "change", "meaningful")


def novelty(df: DataFrame, columns: Sequence[str], train: Column) -> DataFrame:
    """Adds distance, root mean square difference to the train rows' medians, and p, the share of train
    rows whose distance is at most that: a running count over the merged order."""
    stats = df.where(train).agg(*[F.percentile(c, 0.5).alias(f"_c_{c}") for c in columns])
    squares = sum(((F.col(c) - F.col(f"_c_{c}")) * (F.col(c) - F.col(f"_c_{c}")) for c in columns), F.lit(0.0))
    rows = df.join(F.broadcast(stats)).withColumn("distance", F.round(F.sqrt(squares / len(columns)), 9)).withColumn("_t", train.cast("int")).withColumn("_k", F.lit(1))
    w = Window.partitionBy("_k")
    share = F.sum("_t").over(w.orderBy("distance").rangeBetween(Window.unboundedPreceding, 0)) / F.sum("_t").over(w)
    return rows.withColumn("p", share).drop("_t", "_k", *[f"_c_{c}" for c in columns])


def path_statistics(df: DataFrame, path: str) -> DataFrame:
    """Adds what a path of returns since its start, the start's 0 first, did: mae, mfe, max_drawdown (from the
    running peak), time_to_trough and time_to_peak (first positions), terminal, underwater (ends below the
    start), recovery_time (first position after the trough at the start or above), recovered (it had
    fallen below and came back), new_high_after_recovery (above the start later still), and
    fall_first_end_positive."""
    low, high, end, n = F.array_min(path), F.array_max(path), F.element_at(path, -1), F.size(path)
    rows = df.withColumns({"mae": low, "mfe": high, "terminal": end, "time_to_trough": (F.array_position(path, low) - 1).cast("int"), "time_to_peak": (F.array_position(path, high) - 1).cast("int"),
                           "max_drawdown": W.drawdown_of(F.transform(path, lambda x: 1 + x))})
    back = F.array_position(F.transform(path, lambda x, i: (x >= 0) & (i > F.col("time_to_trough"))), True)
    rows = rows.withColumn("recovery_time", F.when(back > 0, back - 1).cast("int"))
    later = F.array_max(F.slice(path, F.col("recovery_time") + 2, n))
    return rows.withColumns({"underwater": F.col("terminal") < 0, "recovered": (F.col("mae") < 0) & F.col("recovery_time").isNotNull(), "new_high_after_recovery": F.coalesce((F.col("recovery_time") + 1 < n) & (later > 0), F.lit(False)),
                             "fall_first_end_positive": (F.col("mae") < 0) & (F.col("terminal") > 0) & (F.col("time_to_trough") < n - 1)})


def path_risk(df: DataFrame, keys: Sequence[str], weight: str, falls: Sequence[float] = (0.03, 0.05, 0.10, 0.15, 0.20)) -> DataFrame:
    """Weighted frequencies of what path_statistics() found, by key: weights are taken as shares of their
    sum; with the number of paths, the effective number and the weighted median drawdown."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("_w", F.col(weight) / F.sum(weight).over(w))
    rows = rows.withColumn("_c", F.sum("_w").over(w.orderBy("max_drawdown").rangeBetween(Window.unboundedPreceding, 0)))
    often = lambda c: F.sum(F.when(c, F.col("_w")).otherwise(0.0))
    flags = ("underwater", "recovered", "new_high_after_recovery", "fall_first_end_positive")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), effective_sample("_w").alias("effective_n"), F.min(F.when(F.col("_c") >= 0.5 - 1e-12, F.col("max_drawdown"))).alias("median_drawdown"), *[often(F.col(f)).alias(f) for f in flags],
                                   *[often(F.col("max_drawdown") <= -x).alias(f"drawdown_{round(x * 100)}") for x in falls])


def path_cosine(a: str, b: str) -> Column:
    """1 less the cosine of two paths; null where one has no length."""
    return 1 - cosine(a, b)
