"""Statistical inference: quantiles, information, transitions, calibration, corrections, stability."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce
from operator import or_

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions.expr import col, ratio, round6
from chronoframe.operators import rules as R
from chronoframe.operators import windows as W


def exclusive_quantile(values: str, n: str, q: float) -> Column:
    """Quantile at (n + 1) q of a sorted array by linear interpolation, held within its ends."""
    p = (F.col(n) + 1) * F.lit(q)
    k = F.greatest(F.lit(1), F.least(F.col(n) - 1, F.floor(p).cast("int")))
    low, high = F.try_element_at(values, k), F.try_element_at(values, k + 1)
    at = F.least(F.greatest(p, F.lit(1.0)), F.col(n).cast("double"))
    return F.when(F.col(n) == 1, F.element_at(values, 1)).otherwise(low + (at - k) * (high - low))


def higher_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """n and, by key, the value at rank ceil((n - 1) q), counted from 0, for each named q: no
    interpolation, and no group is gathered."""
    w = Window.partitionBy(*keys)
    rows = df.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    at = lambda q: F.max(F.when(F.col("_r") == F.ceil((F.col("_n") - 1) * F.lit(q)), F.col(value)))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[at(q).alias(name) for name, q in quantiles.items()])


def quantile_code(df: DataFrame, value: str, ties: Sequence[str], buckets: int, name: str, parts: int = 128) -> DataFrame:
    """Equal-count buckets 1..n in (value, ties) order; rows without a value are left out.

    A value's rank is the rows before its value plus its place among equals.  The running count goes
    over `parts` ranges of values first (by approximate cut points, a bounded list), then over the
    distinct values within a range, so rows or values are never sorted in one task."""
    from pyspark.ml.feature import Bucketizer

    df = df.where(F.col(value).isNotNull())
    cuts = sorted(set(df.approxQuantile(value, [k / parts for k in range(1, parts)], 0.5 / parts)))
    by = df.groupBy(value).agg(F.count("*").alias("_n")).withColumn("_v", F.col(value).cast("double"))
    edges = [-float("inf"), *cuts, float("inf")] if cuts else [-float("inf"), 0.0, float("inf")]
    by = Bucketizer(splits=edges, inputCol="_v", outputCol="_part", handleInvalid="keep").transform(by).drop("_v")
    totals = by.groupBy("_part").agg(F.sum("_n").alias("_here"))
    offsets = totals.select("_part", F.coalesce(F.sum("_here").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    before = by.join(F.broadcast(offsets), "_part").select(value, (F.col("_offset") + F.coalesce(F.sum("_n").over(within), F.lit(0))).alias("_before"))
    total = df.agg(F.count("*").alias("_total"))
    rows = df.join(before, value).join(F.broadcast(total)).withColumn("_r", F.col("_before") + F.row_number().over(Window.partitionBy(value).orderBy(*ties)))
    size, extra = F.floor(F.col("_total") / buckets), F.col("_total") % buckets
    large = extra * (size + 1)
    code = F.when(F.col("_r") <= large, F.floor((F.col("_r") - 1) / (size + 1))).otherwise(extra + F.floor((F.col("_r") - 1 - large) / F.greatest(size, F.lit(1))))
    return rows.withColumn(name, (code + 1).cast("int")).drop("_before", "_total", "_r")


def mutual_information(df: DataFrame, x: str, y: str, ties: Sequence[str], buckets: int) -> DataFrame:
    codes = quantile_code(quantile_code(df.select(x, y, *ties), x, ties, buckets, "_x"), y, ties, buckets, "_y")
    n = codes.groupBy("_x", "_y").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    px, py = F.sum("n").over(Window.partitionBy("_x")) / total, F.sum("n").over(Window.partitionBy("_y")) / total
    p = n.select((F.col("n") / total).alias("p"), px.alias("px"), py.alias("py"))
    return p.agg(round6(F.sum(F.col("p") * F.log(F.col("p") / (F.col("px") * F.col("py"))))).alias("mutual_information"))


def transitions(df: DataFrame, entity: Sequence[str], time: str, state: str, states: Sequence[int]) -> DataFrame:
    """Counts of steps from state to state, and probabilities with one added to each count."""
    pairs = df.select(F.lag(state).over(W.by_time(entity, time)).alias("a"), F.col(state).alias("b")).where("a IS NOT NULL")
    n = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    values = F.array(*[F.lit(s) for s in states])
    grid = df.sparkSession.range(1).select(F.explode(values).alias("a")).select("a", F.explode(values).alias("b"))
    full = grid.join(n, ["a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    total = F.sum("n").over(Window.partitionBy("a"))
    return full.select(F.col("a").alias("from_state"), F.col("b").alias("to_state"), "n", round6((F.col("n") + 1.0) / (total + float(len(states)))).alias("probability"))


def auc(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Tie-averaged area under the curve by ranks; null with one class only."""
    rows = df.withColumn("_r", W.average_rank(score, list(keys)))
    out = rows.groupBy(*keys).agg(F.sum(label).cast("double").alias("p"), F.count("*").cast("double").alias("n"), F.sum(F.col("_r") * F.col(label)).alias("s"))
    return out.select(*keys, F.col("n").cast("long").alias("n"), round6(ratio(F.col("s") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p")))).alias("auc"))


def calibration_error(df: DataFrame, keys: Sequence[str], label: str, probability: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width bins."""
    b = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).cast("int")
    per = df.withColumn("_b", b).groupBy(*keys, "_b").agg(F.count("*").alias("c"), F.avg(label).alias("y"), F.avg(probability).alias("p"))
    return per.groupBy(*keys).agg(round6(F.sum(F.col("c") * F.abs(F.col("y") - F.col("p"))) / F.sum("c")).alias("ece"))


def bh_qvalues(df: DataFrame, p: str, order: Sequence[str]) -> DataFrame:
    """Benjamini-Hochberg q-values over a table of tests (bounded by their number)."""
    w = Window.orderBy(p, *order)
    rows = df.withColumn("_k", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
    q = F.min(F.col(p) * F.col("_n") / F.col("_k")).over(w.rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn("q", F.least(q, F.lit(1.0))).drop("_k", "_n")


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """df computed once, on the executors' disks, for several passes over it; given back at the end."""
    rows = df.persist(StorageLevel.DISK_ONLY)
    try:
        yield rows
    finally:
        rows.unpersist()


def quantiles(df: DataFrame, wanted: Mapping[str, tuple[Column, Sequence[float]]], accuracy: int = 10_000) -> dict[str, tuple[int, list[float | None]]]:
    """By name, how many values the column has and its exact interpolated quantiles at those shares, null
    without values: what percentile() gives, which holds every distinct value in one task.

    Sketches bound each quantile between two values; what lies under them is counted and what lies between
    is ranked, some n / accuracy rows a quantile.  A quantile that its sketch missed is ranked among all
    values.  df is read four times, so it had better be kept.
    """
    targets, spread = [(name, x, p) for name, (x, ps) in wanted.items() for p in ps], 2.0 / accuracy
    around = lambda ps: F.array(*[F.lit(min(1.0, max(0.0, q))) for p in ps for q in (p - spread, p + spread)])
    first = df.agg(*[a for k, (x, ps) in enumerate(wanted.values()) for a in (F.count(x).alias(f"n{k}"), F.percentile_approx(x, around(ps), F.lit(accuracy)).alias(f"q{k}"))]).first()
    n = {name: first[f"n{k}"] for k, name in enumerate(wanted)}
    bounds = [q for k, (_, ps) in enumerate(wanted.values()) for q in zip(*[iter(first[f"q{k}"] or [None] * 2 * len(ps))] * 2)]
    at = [(math.floor((n[name] - 1) * p), math.ceil((n[name] - 1) * p)) for name, _, p in targets]
    found: dict[tuple[int, int], float] = {}

    def rank(which: list[int], sketched: bool) -> None:
        inside = {k: (targets[k][1] >= bounds[k][0]) & (targets[k][1] <= bounds[k][1]) if sketched else targets[k][1].isNotNull() for k in which}
        under = df.agg(*[F.count(F.when(targets[k][1] < bounds[k][0], 1)).alias(f"u{k}") for k in which]).first() if sketched else {f"u{k}": 0 for k in which}
        some = df.where(reduce(or_, inside.values())).select(F.explode(F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("k"), targets[k][1].cast("double").alias("v"))) for k, c in inside.items()]))).alias("x"))
        w = Window.partitionBy("k").orderBy("v")
        some = some.groupBy("x.k", "x.v").agg(F.count("*").alias("c")).withColumn("e", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        hit = lambda k, t: (F.col("k") == k) & (F.col("e") - F.col("c") + under[f"u{k}"] <= t) & (F.col("e") + under[f"u{k}"] > t)
        for r in some.where(reduce(or_, [hit(k, t) for k in which for t in set(at[k])])).collect():
            found.update({(r.k, t): r.v for t in at[r.k] if r.e - r.c + under[f"u{r.k}"] <= t < r.e + under[f"u{r.k}"]})

    missing = lambda: [k for k, (name, _, _) in enumerate(targets) if n[name] and any((k, t) not in found for t in at[k])]
    for sketched in (True, False):
        if left := missing():
            rank(left, sketched)

    def value(k: int, p: float, count: int) -> float | None:
        if not count:
            return None
        (low, high), place = at[k], (count - 1) * p
        a, b = found[k, low], found[k, high]
        return a if low == high or a == b else (high - place) * a + (place - low) * b

    out: dict[str, tuple[int, list[float | None]]] = {name: (n[name], []) for name in wanted}
    for k, (name, _, p) in enumerate(targets):
        out[name][1].append(value(k, p, n[name]))
    return out


def psi(reference: DataFrame, current: DataFrame, value: str, bins: int = 10, floor: float = 1e-6) -> DataFrame:
    """(psi, status): population stability index over the quantile bins of the reference.

    Bins are closed on the left, the last on both sides; values outside are in none, and shares are of
    all values.  Equal edges are one; fewer than two bins give 0 and stable; a sample with fewer values
    than bins gives null and insufficient_sample.
    """
    x = F.col(value)
    ref, cur = reference.where(x.isNotNull()), current.where(x.isNotNull())
    n, cuts = quantiles(ref, {"cuts": (x, [k / bins for k in range(bins + 1)])})["cuts"]
    spark = reference.sparkSession
    if n < bins or (m := cur.count()) < bins:
        return spark.createDataFrame([(None, "insufficient_sample")], "psi double, status string")
    edges = sorted(set(cuts))
    if len(edges) < 3:
        return spark.createDataFrame([(0.0, "stable")], "psi double, status string")
    inside = [(x >= a) & ((x < b) if b < edges[-1] else (x <= b)) for a, b in zip(edges, edges[1:])]
    shares = lambda df, n: df.agg(*[(F.count(F.when(c, 1)) / n).alias(f"s{k}") for k, c in enumerate(inside)]).first()
    both = [(max(a, floor), max(b, floor)) for a, b in zip(shares(ref, n), shares(cur, m))]
    found = spark.createDataFrame([(sum((b - a) * math.log(b / a) for a, b in both),)], "psi double")
    return found.withColumn("status", R.label(R.PSI_STATUS, "stable"))


def autocovariances(df: DataFrame, keys: Sequence[str], time: str, value: str, lags: int) -> DataFrame:
    """Columns n, mean, g0..gL by key: sums of products of demeaned values over n."""
    w = Window.partitionBy(*keys)
    rows = df.where(F.col(value).isNotNull()).withColumn("_m", F.avg(value).over(w)).withColumn("_z", F.col(value) - F.col("_m"))
    t = w.orderBy(time)
    for k in range(1, lags + 1):
        rows = rows.withColumn(f"_z{k}", F.lag("_z", k).over(t))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.first("_m").alias("mean"), (F.sum(F.col("_z") * F.col("_z")) / F.count("*")).alias("g0"),
                                   *[(F.coalesce(F.sum(F.col("_z") * F.col(f"_z{k}")), F.lit(0.0)) / F.count("*")).alias(f"g{k}") for k in range(1, lags + 1)])


def newey_west(cov: DataFrame, lags: int) -> Column:
    """t value of the mean with Bartlett weights."""
    variance = F.col("g0") + sum((2.0 * (1 - k / (lags + 1)) * F.col(f"g{k}") for k in range(1, lags + 1)), F.lit(0.0))
    return ratio("mean", F.sqrt(F.greatest(variance, F.lit(0.0)) / F.col("n")))


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p, z2 = ratio(successes.cast("double"), n.cast("double")), z * z
    centre, under = p + z2 / (2 * n), 1 + F.lit(z2) / n
    half = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return (centre - half) / under, (centre + half) / under


def effective_sample_size(df: DataFrame, keys: Sequence[str], time: str, value: str, most_lag: int | None = None) -> DataFrame:
    """(n, ar1_n, sequence_n) by key: observations worth by first-order autocorrelation, and by the run of
    positive ones, lag k weighted 1 - k / n, up to the first that isn't positive and to sqrt(n) lags.

    Rows are numbered by key, and each lag is one lag() over the same sorted window; the number of lags
    is the square root of the longest series.  Under three rows, or without variation, n itself.
    """
    w = Window.partitionBy(*keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, time, (F.col(value) - F.avg(value).over(w)).alias("_z"), F.count(F.lit(1)).over(w).alias("_n"))
    longest = rows.agg(F.max("_n")).first()[0] or 0
    lags = range(1, max(1, min(most_lag or int(longest**0.5), longest - 2)) + 1)
    line = w.orderBy(time)
    rows = rows.withColumns({f"_p{k}": F.col("_z") * F.lag("_z", k).over(line) for k in lags})
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("_z") * F.col("_z")).alias("_den"), F.array(*[F.coalesce(F.sum(f"_p{k}"), F.lit(0.0)) for k in lags]).alias("_c"))
    top = F.least(F.lit(most_lag) if most_lag else F.floor(F.sqrt("n")), F.col("n") - 2).cast("int")
    rho = F.transform(F.slice("_c", 1, F.greatest(top, F.lit(1))), lambda c: ratio(c, "_den"))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(False).alias("stop"), F.lit(0).alias("k"))

    def step(acc: Column, r: Column) -> Column:
        stop = acc["stop"] | (F.round(r, 12) <= 0)
        k = acc["k"] + 1
        return F.struct((acc["sum"] + F.when(stop, 0.0).otherwise((1 - k / F.col("n")) * r)).alias("sum"), stop.alias("stop"), k.alias("k"))

    n = F.col("n").cast("double")
    whole = (F.col("n") < 3) | (F.col("_den") <= 0)
    total = F.when(whole, 0.0).otherwise(F.aggregate(rho, start, step, lambda acc: acc["sum"]))
    first = ratio(F.element_at("_c", 1), "_den")
    return out.select(*keys, "n", (n * (1 - first) / (1 + first)).alias("ar1_n"), F.when(whole, n).otherwise(F.greatest(F.lit(1.0), F.least(n, n / (1 + 2 * total)))).alias("sequence_n"))


def outcomes(df: DataFrame, keys: Sequence[str], time: str, value: str, drawdown: str, z: float = 1.96) -> DataFrame:
    """What became of like days, by key: number, share of gains with its Wilson interval, mean, median,
    quartiles, extremes, drawdowns, the sample's quality, and two warnings: concentrated, where over half
    stand in one calendar year, and extreme, where the mean moves by over 0.02 without the best and worst.
    Rows without a value are left out."""
    rows = df.where(F.col(value).isNotNull()).withColumn("_y", F.count(F.lit(1)).over(Window.partitionBy(*keys, F.year(time))))
    v, n = F.col(value), F.col("n").cast("double")
    q = lambda p: F.percentile(v, p)
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count(F.when(v > 0, 1)).alias("_p"), F.avg(v).alias("mean"), q(0.5).alias("median"), q(0.25).alias("q25"), q(0.75).alias("q75"), F.max(v).alias("best"), F.min(v).alias("worst"),
                                  F.avg(drawdown).alias("mean_max_drawdown"), F.percentile(drawdown, 0.5).alias("median_max_drawdown"), F.max("_y").alias("_top"), F.sum(v).alias("_s"))
    low, high = wilson(F.col("_p"), F.col("n"), z)
    trimmed = ratio(F.col("_s") - F.col("best") - F.col("worst"), n - 2)
    return out.select(*keys, "n", (F.col("_p") / n).alias("positive_frequency"), low.alias("positive_low"), high.alias("positive_high"), "mean", "median", "q25", "q75", "best", "worst", "mean_max_drawdown", "median_max_drawdown",
                      R.label(R.SAMPLE_QUALITY, R.SAMPLE_QUALITY_ELSE).alias("quality"), (F.col("_top") / n > 0.5).alias("concentrated"), ((F.col("n") >= 3) & F.coalesce(F.abs(F.col("mean") - trimmed) > 0.02, F.lit(False))).alias("extreme"))
