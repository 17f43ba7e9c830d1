"""Row-count windows, ranks, runs and latest-wins choices over (entity, time) panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from chronoframe.functions.expr import col, up


def by_time(entity: Sequence[str] | str, time: str) -> WindowSpec:
    keys = [entity] if isinstance(entity, str) else list(entity)
    return Window.partitionBy(*keys).orderBy(time)


def frame(w: WindowSpec, rows: int, shift: int = 0) -> WindowSpec:
    """The last `rows` rows; shifted ones end `shift` rows before the current row."""
    return w.rowsBetween(-(rows - 1) - shift, -shift)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def rolling(agg: Column, values: Column, over: WindowSpec, min_periods: int) -> Column:
    """agg over the frame, null while fewer than min_periods of `values` are non-null."""
    return F.when(F.count(values).over(over) >= min_periods, agg.over(over))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by an explicit order: revisions, vintages, priorities, duplicates."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def average_rank(value: str | Column, part: Sequence[str], ascending: bool = True) -> Column:
    """Rank with ties averaged among the non-null values of the partition; null for null."""
    x = col(value)
    order = up(x) if ascending else x.desc_nulls_last()
    rank = F.rank().over(Window.partitionBy(*part).orderBy(order))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*part, x))
    return F.when(x.isNotNull(), rank + (ties - 1) / 2.0)


def percentile_rank(value: str | Column, part: Sequence[str]) -> Column:
    """Average rank over the number of non-null values."""
    return average_rank(value, part) / F.count(col(value)).over(Window.partitionBy(*part))


def run_id(df: DataFrame, entity: Sequence[str], time: str, value: str, name: str = "run") -> DataFrame:
    """Number the runs of equal values by entity, from 1; null equals null."""
    w = by_time(entity, time)
    change = F.when(F.row_number().over(w) == 1, 1).otherwise((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"))
    return df.withColumn("_c", change).withColumn(name, F.sum("_c").over(so_far(w))).drop("_c")


def run_length(df: DataFrame, entity: Sequence[str], time: str, value: str, name: str = "duration") -> DataFrame:
    """How many rows the current value has lasted."""
    runs = run_id(df, entity, time, value, "_run")
    keys = [entity] if isinstance(entity, str) else list(entity)
    return runs.withColumn(name, F.row_number().over(by_time([*keys, "_run"], time))).drop("_run")


def episodes(df: DataFrame, entity: Sequence[str], time: str, gap: Column, name: str = "episode") -> DataFrame:
    """Number episodes: a new one begins where gap (over the entity's time order) is true."""
    w = by_time(entity, time)
    return df.withColumn("_g", F.coalesce(gap, F.lit(True)).cast("int")).withColumn(name, F.sum("_g").over(so_far(w))).drop("_g")


def sessions(df: DataFrame, time: str, name: str = "session") -> DataFrame:
    """Distinct times numbered from 1: a trading calendar is small, one row a date."""
    return df.select(time).distinct().withColumn(name, F.row_number().over(Window.orderBy(time)))


def drawdown_of(values: Column) -> Column:
    """Smallest value/peak - 1 along an array, the running peak from its first value."""
    start = F.struct(F.lit(None).cast("double").alias("peak"), F.lit(0.0).alias("low"))

    def step(acc: Column, x: Column) -> Column:
        peak = F.greatest(acc["peak"], x)
        return F.struct(peak.alias("peak"), F.least(acc["low"], x / peak - 1).alias("low"))

    return F.aggregate(values, start, step, lambda acc: acc["low"])
