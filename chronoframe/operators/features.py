"""The standard feature set: what is known of an entity at the end of each of its rows."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from chronoframe.functions.expr import ratio
from chronoframe.functions.workers import ship
from chronoframe.operators import windows as W
from chronoframe.operators.joins import small

#: Windows in rows.
RETURNS, MEANS, SLOPES, DEVIATIONS, YEAR_ROWS = (1, 5, 20, 60, 120, 250), (20, 50, 100, 200), (20, 50, 200), (20, 60, 250), 250
STRENGTHS, BETAS, TURNOVERS, DRAWDOWNS = (20, 60, 120, 250), (60, 250), (20, 60), (60, 250)


#: Rows before a batch that its windows reach: a lag of 250, and a slope over 5 of a mean over 200.
REACH = 256
WHOLE = {"days_vs_sma_200", "zero_volume_days_20"}


def names(benchmark: bool) -> list[str]:
    out = [f"return_{n}" for n in RETURNS] + [f"sma_{n}" for n in MEANS] + [f"price_to_sma_{n}" for n in MEANS] + [f"sma_{n}_slope" for n in SLOPES]
    out += ["sma_50_above_200", "days_vs_sma_200", "range_52w_position", "distance_to_52w_high", "distance_to_52w_low", *[f"volatility_{n}" for n in DEVIATIONS], "downside_volatility_60"]
    out += [f"max_drawdown_{n}" for n in DRAWDOWNS] + ["current_drawdown"] + [f"turnover_mean_{n}" for n in TURNOVERS] + [f"turnover_median_{n}" for n in TURNOVERS] + ["turnover_to_mean_20", "zero_volume_days_20"]
    return out + ([f"relative_strength_{n}" for n in STRENGTHS] + [x for n in BETAS for x in (f"beta_{n}", f"correlation_{n}")] if benchmark else [])


def before(x: np.ndarray, k: int) -> np.ndarray:
    """x of k rows before; zeros at the start."""
    out = np.zeros_like(x)
    out[k:] = x[:len(x) - k] if k < len(x) else x[:0]
    return out


def summed(x: np.ndarray, n: int) -> np.ndarray:
    """Sums over the last n rows, by sums over powers of two: no running total whose error grows."""
    part, at, out = x, 0, np.zeros_like(x)
    for bit in range(n.bit_length()):
        if n >> bit & 1:
            out = out + before(part, at)
            at += 1 << bit
        part = part + before(part, 1 << bit)
    return out


def extreme(f: np.ufunc, x: np.ndarray, n: int) -> np.ndarray:
    width, part = 1, x
    while 2 * width <= n:
        part = f(part, before(part, width))
        width *= 2
    return f(part, before(part, n - width))


def moments(n: int, *series: np.ndarray) -> list[np.ndarray]:
    """Sample variances over the last n rows, and of two series their covariance: taken about the window's
    first value, so one that doesn't vary gives exactly 0."""
    size, m = len(series[0]), max(0, len(series[0]) - n + 1)
    pairs = [(a, a) for a in range(len(series))] + ([(0, 1)] if len(series) == 2 else [])
    sums, products = [np.zeros(m) for _ in series], [np.zeros(m) for _ in pairs]
    for k in range(1, n if m else 0):
        moves = [x[k:k + m] - x[:m] for x in series]
        for total, d in zip(sums, moves):
            total += d
        for total, (a, b) in zip(products, pairs):
            total += moves[a] * moves[b]
    out = [(p - sums[a] * sums[b] / n) / (n - 1) for p, (a, b) in zip(products, pairs)]
    return [np.concatenate([np.zeros(size - m), np.maximum(v, 0) if a == b else v]) for v, (a, b) in zip(out, pairs)]


def drawdown(x: np.ndarray, n: int) -> np.ndarray:
    """Smallest value over the running peak - 1 in the last n rows, the first of them a peak."""
    m = max(0, len(x) - n + 1)
    peak, low = x[:m].copy(), np.zeros(m)
    for k in range(n if m else 0):
        now = x[k:k + m]
        np.maximum(peak, now, out=peak)
        np.fmin(low, now / peak - 1, out=low)
    return np.concatenate([np.zeros(len(x) - m), low])


def median(x: np.ndarray, n: int) -> np.ndarray:
    if len(x) < n:
        return np.zeros(len(x))
    part = np.partition(np.lib.stride_tricks.sliding_window_view(x, n), (n // 2 - 1, n // 2), axis=1)
    return np.concatenate([np.zeros(n - 1), 0.5 * part[:, n // 2 - 1] + 0.5 * part[:, n // 2]])


def rounded(x: np.ndarray, places: int) -> np.ndarray:
    """Halves of the binary value away from zero."""
    y = np.abs(x) * 10.0**places
    low = np.floor(y)
    return np.where(np.isfinite(y), np.copysign((low + (y - low >= 0.5)) / 10.0**places, x), x)


def _features(t: Mapping[str, tuple[np.ndarray, np.ndarray]], n: np.ndarray, start: int, sessions: float) -> tuple[dict[str, tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Values and where they are known, and each row's start of its run above or below the mean of 200.
    t: close, value, zero, peak, r and maybe b with where they are known; n: the entity's row number;
    start: the run's start at the row before which this batch begins (row REACH's, by `t["own"]`)."""
    (c, c_ok), (v, _), (zero, _), (peak, p_ok), (r, r_ok) = (t[k] for k in ("close", "value", "zero", "peak", "r"))
    first = int(t["own"][0])
    out: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def whole(ok: np.ndarray, rows: int) -> np.ndarray:
        bad = np.concatenate([[0], np.cumsum(~ok)])
        at = np.arange(1, len(ok) + 1)
        return (n >= rows) & (bad[at] == bad[np.maximum(at - rows, 0)])

    def over(a: np.ndarray, a_ok: np.ndarray, b: np.ndarray, b_ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return a / b, a_ok & b_ok & (b != 0)

    def less_one(x: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return x[0] - 1, x[1]

    lag = lambda x, ok, k: (before(x, k), before(ok, k) & (n > k))
    back = {k: less_one(over(c, c_ok, *lag(c, c_ok, k))) for k in sorted({*RETURNS, *STRENGTHS})}
    for k in RETURNS:
        out[f"return_{k}"] = back[k]
    for k in MEANS:
        out[f"sma_{k}"] = summed(c, k) / k, whole(c_ok, k)
    for k in MEANS:
        out[f"price_to_sma_{k}"] = less_one(over(c, c_ok, *out[f"sma_{k}"]))
    for k in SLOPES:
        out[f"sma_{k}_slope"] = less_one(over(*out[f"sma_{k}"], *lag(*out[f"sma_{k}"], 5)))
    every = np.ones(len(n), bool)
    (s50, s50_ok), (s200, s200_ok) = out["sma_50"], out["sma_200"]
    out["sma_50_above_200"] = (s50_ok & s200_ok & ((s50 > s200) | np.isnan(s50) & ~np.isnan(s200))).astype(float), every
    above = c_ok & s200_ok & ((c >= s200) | np.isnan(c))  # as in SQL nothing is over NaN
    step = (n == 1) | (above != before(above, 1))
    begins = np.where(step, n, 0)
    if first:
        step[first - 1], begins[first - 1] = True, start
    begins = begins[np.maximum.accumulate(np.where(step, np.arange(len(n)), 0))]
    out["days_vs_sma_200"] = np.where(above, n - begins + 1, -1), every
    high, low, year = extreme(np.maximum, c, YEAR_ROWS), extreme(np.fmin, c, YEAR_ROWS), whole(c_ok, YEAR_ROWS)
    out["range_52w_position"] = over(c - low, c_ok & year, high - low, year)
    out["distance_to_52w_high"], out["distance_to_52w_low"] = less_one(over(c, c_ok, high, year)), less_one(over(c, c_ok, low, year))
    b, b_ok = t.get("b", (None, None))
    varied = {k: moments(k, b, r) if b is not None and k in BETAS else moments(k, r) for k in sorted({*DEVIATIONS, *(BETAS if b is not None else ())})}
    for k in DEVIATIONS:
        out[f"volatility_{k}"] = np.sqrt(varied[k][1 if b is not None and k in BETAS else 0]) * sessions**0.5, whole(r_ok, k)
    neg = r_ok & (r < 0)
    inside = [before(neg, k) & (n > k) for k in range(60)]
    count = np.sum(inside, axis=0)
    mean = sum(np.where(i, before(r, k), 0.0) for k, i in enumerate(inside)) / np.maximum(count, 1)
    square = sum(np.where(i, before(r, k) - mean, 0.0) ** 2 for k, i in enumerate(inside))
    out["downside_volatility_60"] = np.sqrt(square / np.maximum(count - 1, 1)) * sessions**0.5, count >= 20
    for k in DRAWDOWNS:
        out[f"max_drawdown_{k}"] = drawdown(c, k), whole(c_ok, k)
    out["current_drawdown"] = less_one(over(c, c_ok, peak, p_ok))
    for k in TURNOVERS:
        out[f"turnover_mean_{k}"] = summed(v, k) / k, n >= k
    for k in TURNOVERS:
        out[f"turnover_median_{k}"] = median(v, k), n >= k
    out["turnover_to_mean_20"] = over(v, every, summed(v, 20) / 20, n >= 20)
    out["zero_volume_days_20"] = summed(zero, 20).astype(np.int64), n >= 20
    if b is not None:
        lb_ok = b_ok & ~(b <= -1)
        lb = np.log1p(np.where(lb_ok, b, 0.0))
        for k in STRENGTHS:
            out[f"relative_strength_{k}"] = less_one(over(1 + back[k][0], back[k][1], np.exp(summed(lb, k)), whole(lb_ok, k)))
        for k in BETAS:
            x, y, xy = varied[k]
            both, dx, dy = whole(r_ok & b_ok, k), np.sqrt(x), np.sqrt(y)
            out[f"beta_{k}"], out[f"correlation_{k}"] = over(xy, both, dx * dx, both), over(xy, both, dx * dy, both)
    return out, begins


def standard(prices: DataFrame, benchmark: DataFrame | None = None, entity: str = "entity", time: str = "d", close: str = "close",
             value: str = "value", volume: str = "volume", sessions: float = 252.0, places: Mapping[str, int] | None = None) -> DataFrame:
    """Adds 43 features (31 without a benchmark) to prices(entity, d, close, value, volume).

    Windows count the entity's rows and give null until they are full; a zero denominator and any value
    that isn't finite give null.  One shuffle and one sort by entity serve all of them; the windows are
    computed in Arrow batches, each with the rows before it that they reach, so an entity may be of any
    length.  benchmark(d, close), a row a session, is joined by time; the entity's rows keep their order.
    Features named in places are rounded, by their binary value.
    """
    w = W.by_time(entity, time)
    rows = prices
    if benchmark is not None:
        b = benchmark.select(F.col(time).alias("_bt"), F.col(close).alias("_bc"))
        b = small(b.withColumn("_b", ratio("_bc", F.lag("_bc").over(W.by_time([], "_bt"))) - 1).drop("_bc"))
        rows = rows.join(b, rows[time] == b["_bt"], "left").drop("_bt")
    kept, places = list(prices.columns), dict(places or {})
    extra = {"_close": F.col(close).cast("double"), "_value": F.coalesce(F.col(value).cast("double"), F.lit(0.0)), "_zero": (F.coalesce(volume, F.lit(0)) <= 0).cast("double"), "_n": F.row_number().over(w).cast("long"),
             "_peak": F.max(close).over(W.so_far(w)).cast("double"), "_r": (ratio(close, F.lag(close).over(w)) - 1).cast("double")}
    rows = rows.withColumns(extra).sortWithinPartitions(entity, time)  # the windows' own order
    out = names(benchmark is not None)
    raw = {f"return_{n}" for n in RETURNS} | {f"sma_{n}" for n in MEANS} | WHOLE  # these keep NaN
    inputs = ["_close", "_value", "_zero", "_peak", "_r"] + ["_b"] * (benchmark is not None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, start = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own = pa.Table.from_batches([batch.select([*inputs, "_n"])])
            first = int(own["_n"][0].as_py())
            begin = min(REACH, first - 1) if tail is not None else 0
            every = pa.concat_tables([tail.slice(len(tail) - begin), own]) if begin else own
            n = every["_n"].to_numpy()
            t = {k[1:]: (pyarrow.compute.fill_null(every[k], 0.0).to_numpy(), pyarrow.compute.is_valid(every[k]).to_numpy()) for k in inputs}
            with np.errstate(all="ignore"):
                found, begins = _features(t | {"own": (begin, None)}, n, start, sessions)
                columns = []
                for k in out:
                    x, ok = (y[begin:] for y in found[k])
                    if k not in raw:
                        ok = ok & np.isfinite(x)
                    columns.append(pa.array(rounded(x, places[k]) if k in places else x, mask=~ok))
            tail, start = every.slice(max(0, len(every) - REACH)), int(begins[-1])
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], *columns], names=[*kept, *out])

    ship(prices.sparkSession)
    schema = StructType([*prices.schema.fields, *[StructField(k, LongType() if k in WHOLE else DoubleType()) for k in out]])
    return rows.select(*kept, *inputs, "_n").mapInArrow(run, schema)
