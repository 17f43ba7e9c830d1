"""Labels: forward returns with their paths, and what entry rules would have earned."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from chronoframe.functions.expr import ratio
from chronoframe.functions.workers import ship
from chronoframe.operators import rules as R
from chronoframe.operators import windows as W
from chronoframe.operators.joins import small

#: Horizons and delays in sessions, moves and dips as shares.
HORIZONS = (1, 5, 20, 60, 120, 250)
MOVES = (0.03, 0.05, 0.10, 0.15)
DELAYS = {"BUY_NOW": 1, "WAIT_3": 3, "WAIT_5": 5, "WAIT_10": 10}
DIPS = {"BUY_AFTER_DIP_2": 0.02, "BUY_AFTER_DIP_3": 0.03}


def paths(x: np.ndarray, horizons: Sequence[int], sessions: float) -> dict[int, tuple[np.ndarray, ...]]:
    """By horizon: total return, highest and lowest of the path, its drawdown from the running peak (the
    start is one), first session of the highest and of the lowest, deviation of the path's steps, share of
    steps that don't fall, realised deviation of log steps.  x: levels, the latest first; a row whose
    horizon isn't held gets values that mean nothing.  One walk ahead serves all horizons."""
    size = len(x)
    ahead = lambda y, k: np.concatenate([np.ones(min(k, size)), y[:max(0, size - k)]])
    logs = np.log(x / np.concatenate([x[1:], [1.0]]))
    last, peak, dd, s, ss, one, two = (np.zeros(size) for _ in range(7))
    ups, high_at, low_at = (np.zeros(size, np.int32) for _ in range(3))
    high, low, first = np.full(size, -np.inf), np.full(size, np.inf), ahead(logs, 1)
    out = {}
    for k in range(1, max(horizons) + 1):
        p = ahead(x, k) / x - 1
        np.maximum(peak, p, out=peak)
        np.minimum(dd, (1 + p) / (1 + peak) - 1, out=dd)
        move = p - last
        s += move
        ss += move * move
        ups += move >= 0
        high_at[p > high] = k
        low_at[p < low] = k
        np.maximum(high, p, out=high)
        np.minimum(low, p, out=low)
        gap = ahead(logs, k) - first  # about the first step: equal steps deviate by exactly 0
        one += gap
        two += gap * gap
        last = p
        if k in horizons:
            sd, vol = (np.sqrt(np.maximum(v, 0.0)) for v in (ss / k - (s / k) * (s / k), (two - one * one / k) / k))
            out[k] = p, high.copy(), low.copy(), dd.copy(), high_at.copy(), low_at.copy(), sd, ups / k, vol * sessions**0.5
    return out


def _ranked(levels: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """(entity, d, level, ranks, day): for each row, by horizon, twice its average rank among the returns of
    its date (0: unknown), and their median and number, as bytes: only these travel back to the entities."""
    w = W.by_time("entity", "d")
    rows = levels.select("entity", "d", "level", *[(F.lead("level", h).over(w) / F.col("level") - 1).alias(f"r{h}") for h in horizons])

    def rank(t: pa.Table) -> pa.Table:
        ranks, middle, number = np.zeros((len(t), len(horizons)), "<i4"), np.full(len(horizons), np.nan), np.zeros(len(horizons))
        for k, h in enumerate(horizons):
            known = t[f"r{h}"].is_valid().to_numpy()
            x = t[f"r{h}"].drop_null().to_numpy()
            if len(x):
                order = np.sort(x)
                n = number[k] = len(x)
                ranks[known, k] = np.searchsorted(order, x, "left") + 1 + np.searchsorted(order, x, "right")
                middle[k] = 0.5 * order[(n - 1) // 2] + 0.5 * order[n // 2]
        day = np.concatenate([middle, number]).astype("<f8").tobytes()
        own = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * len(horizons)), len(t), [None, pa.py_buffer(ranks.tobytes())]).cast(pa.binary())
        return pa.table({"entity": t["entity"], "d": t["d"], "level": t["level"], "ranks": own, "day": pa.array([day] * len(t), pa.binary())})

    schema = StructType([*[levels.schema[c] for c in ("entity", "d", "level")], StructField("ranks", BinaryType()), StructField("day", BinaryType())])
    return rows.groupBy("d").applyInArrow(rank, schema)


def supervised(levels: DataFrame, horizons: Sequence[int] = HORIZONS, benchmark: DataFrame | None = None, sessions: float = 252.0) -> DataFrame:
    """A row for each row of levels(entity, d, level) and horizon whose end is known.

    level is a total-return index over zero.  Columns: exit_date, total_return, log_return,
    excess_benchmark (over benchmark(d, level), null where either date is missing there),
    excess_median, percentile_rank (ties averaged), eligible_count over the entities of that date and
    horizon, top_10/top_20/bottom_10/bottom_20, move_up_* and move_down_*, mfe, mae, max_drawdown (the
    start is a peak), time_to_high and time_to_low (first), path_shape, realised_vol (population
    deviation of log steps, annualised), return_over_vol, return_over_downside, calmar; null where the
    denominator is zero.
    """
    spark, horizons = levels.sparkSession, list(horizons)
    ship(spark)
    levels = levels.select("entity", "d", F.col("level").cast("double").alias("level"))
    latest = W.by_time("entity", F.col("d").desc())
    rows = _ranked(levels, horizons).repartition("entity").withColumn("n", F.row_number().over(latest)).sortWithinPartitions("entity", F.col("d").desc())
    reach = max(horizons)
    kinds = [levels.schema["entity"], levels.schema["d"], StructField("horizon", IntegerType()), StructField("exit_date", levels.schema["d"].dataType)]
    kinds += [StructField(c, IntegerType() if c.startswith("time") else DoubleType()) for c in ("total_return", "mfe", "mae", "max_drawdown", "time_to_high", "time_to_low", "sd", "ups", "realised_vol")]
    kinds += [StructField("middle", DoubleType()), StructField("percentile_rank", DoubleType()), StructField("eligible_count", LongType())]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(batch.schema.get_field_index("n")).to_numpy()
            own = pa.Table.from_batches([batch.select(["d", "level"])])
            begin = min(reach, int(n[0]) - 1) if tail is not None else 0
            every = pa.concat_tables([tail.slice(len(tail) - begin), own]) if begin else own
            tail = every.slice(max(0, len(every) - reach))
            dates = every["d"].combine_chunks()
            ranks = np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("ranks")).to_pylist()), "<i4").reshape(len(n), len(horizons))
            day = np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("day")).to_pylist()), "<f8").reshape(len(n), 2, len(horizons))
            with np.errstate(all="ignore"):
                found = paths(every["level"].to_numpy(), horizons, sessions)
            for k, h in enumerate(horizons):
                at = np.flatnonzero(n > h)
                if not len(at):
                    continue
                take, count = pa.array(at), day[at, 1, k]
                columns = [batch.column(0).take(take), batch.column(1).take(take), pa.array(np.full(len(at), h, np.int32)), dates.take(pa.array(at + begin - h))]
                columns += [pa.array(v[at + begin]) for v in found[h]] + [pa.array(day[at, 0, k]), pa.array(ranks[at, k] / 2.0 / count), pa.array(count.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kinds])

    rows = rows.select("entity", "d", "level", "ranks", "day", "n").mapInArrow(walk, StructType(kinds))
    rows = rows.withColumns({"terminal": F.col("total_return"), "low": F.col("mae"), "high": F.col("mfe"), "log_return": F.log1p("total_return")}).withColumn("path_shape", R.label(R.PATH_SHAPE, "sideways"))
    rows = rows.withColumns({"return_over_vol": ratio("total_return", "realised_vol"), "return_over_downside": ratio("total_return", F.abs(F.least("mae", F.lit(0.0)))),
                             "calmar": ratio("total_return", F.abs("max_drawdown")), "excess_median": F.col("total_return") - F.col("middle")})
    rows = rows.withColumns({f"move_up_{round(m * 100)}": F.col("total_return") > m for m in MOVES} | {f"move_down_{round(m * 100)}": F.col("total_return") < -m for m in MOVES})
    first = ["entity", "d", "horizon", "exit_date", "realised_vol", "total_return", "mfe", "mae", "max_drawdown", "time_to_high", "time_to_low", "log_return", "path_shape", "return_over_vol", "return_over_downside", "calmar"]
    rows = rows.select(*first, *[f"move_{way}_{round(m * 100)}" for way in ("up", "down") for m in MOVES], "excess_median", "percentile_rank", "eligible_count")
    rank = F.col("percentile_rank")
    rows = rows.withColumns({"top_10": rank >= 0.9, "top_20": rank >= 0.8, "bottom_10": rank <= 0.1, "bottom_20": rank <= 0.2})
    if benchmark is None:
        return rows.withColumn("excess_benchmark", F.lit(None).cast("double"))
    known = small(benchmark.select(F.col("d").alias("_d"), F.col("level").alias("_b")))
    begin, end = known.toDF("_d0", "_b0"), known.toDF("_d1", "_b1")
    rows = rows.join(begin, rows["d"] == begin["_d0"], "left").join(end, rows["exit_date"] == end["_d1"], "left")
    return rows.withColumn("excess_benchmark", F.col("total_return") - (ratio("_b1", "_b0") - 1)).drop("_d0", "_b0", "_d1", "_b1")


def entries(levels: DataFrame, horizons: Sequence[int] = HORIZONS, delays: Mapping[str, int] = DELAYS, dips: Mapping[str, float] = DIPS, within: int = 10) -> DataFrame:
    """A row for each row of levels(entity, d, level), horizon whose end is known, and entry policy.

    A delay enters that many sessions later, at the horizon's end at the latest.  A dip enters at the
    first of the next `within` sessions, and within the horizon, whose level is at most (1 - dip) of
    the start; where there is none it isn't entered.  entry_improvement is against an entry at the next
    session; missed_return is what that one earned over the policy, all of it where not entered.
    """
    w, most = W.by_time("entity", "d"), max([*delays.values(), within])
    ahead = w.rowsBetween(1, most)
    rows = levels.select("entity", "d", "level", F.collect_list(F.struct("d", "level")).over(ahead).alias("near"),
                         F.array(*[F.struct(F.lit(h).alias("horizon"), F.lead("d", h).over(w).alias("exit_date"), F.lead("level", h).over(w).alias("exit")) for h in horizons]).alias("_h"))
    rows = rows.select("entity", "d", "level", "near", F.inline("_h")).where("exit_date IS NOT NULL")
    late = lambda k: F.element_at("near", F.least(F.lit(k), F.col("horizon")))
    null = F.lit(None).cast("double")
    parts = [F.struct(F.lit(name).alias("policy"), null.alias("threshold"), late(k).alias("entry")) for name, k in delays.items()]
    for name, dip in dips.items():
        floor = F.col("level") * (1 - dip)
        hits = F.filter(F.slice("near", 1, F.least(F.lit(within), F.col("horizon"))), lambda x: x["level"] <= F.col("level") * (1 - dip))  # noqa: B023
        parts.append(F.struct(F.lit(name).alias("policy"), floor.alias("threshold"), F.try_element_at(hits, F.lit(1)).alias("entry")))
    rows = rows.withColumn("buy", F.element_at("near", 1)["level"]).select("entity", "d", "horizon", "exit_date", "exit", "buy", F.inline(F.array(*parts)))
    entry, buy_now = F.col("entry.level"), ratio("exit", "buy") - 1
    gained = ratio("exit", entry) - 1
    return rows.select("entity", "d", "horizon", "policy", "threshold", F.col("entry.d").alias("entry_date"), entry.alias("entry_price"), "exit_date", gained.alias("policy_return"), buy_now.alias("buy_now_return"),
                       (1 - ratio(entry, "buy")).alias("entry_improvement"), (buy_now - F.coalesce(gained, F.lit(0.0))).alias("missed_return"), entry.isNotNull().alias("entered"))
