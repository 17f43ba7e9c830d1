"""Point-in-time joins: as-of in both directions, validity intervals, grids, evidence links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
         columns: Sequence[str], inner: bool = False, forward: bool = False, bucket: str | None = None) -> DataFrame:
    """Each left row with the last right row at or before its time (forward: first at or after).

    One union and one window: linear in both sides, no range join.  Exact matches count.  Of right
    rows at the same time the one last by `columns` order wins (forward: first), so results are
    deterministic.  inner drops left rows without a match.

    bucket ('year', 'month', 'day', 'hour') cuts each key's time line into parts that are filled on
    their own, with what the parts before hand on: for series that are few or very long, so that one
    series is never one task.  Results are the same.
    """
    packed = F.struct(F.col(right_time).alias("_at"), *[F.col(c) for c in columns])
    seen = right.select(*keys, F.col(right_time).cast("timestamp").alias("_t"), packed.alias("_seen"))
    asked = left.select(F.struct("*").alias("_row"), *keys, F.col(left_time).cast("timestamp").alias("_t"))
    a = asked.select("_row", *keys, "_t", F.lit(1).alias("_side"), F.lit(None).cast(seen.schema["_seen"].dataType).alias("_seen"))
    b = seen.select(F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"), *keys, "_t", F.lit(0).alias("_side"), "_seen")
    # Forward is backward in reversed time: a frame that only grows costs one pass either way.
    order = [F.col("_t").desc(), F.col("_side"), F.col("_seen").desc()] if forward else [F.col("_t"), F.col("_side"), F.col("_seen")]
    both, parts = a.unionByName(b), list(keys)
    if bucket:
        both = both.withColumn("_b", F.date_trunc(bucket, "_t"))
        parts.append("_b")
    w = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("_found", F.last("_seen", ignorenulls=True).over(w)).where(F.col("_row").isNotNull())
    if bucket:
        edge = F.struct("_t", "_seen")
        per = both.groupBy(*parts).agg((F.min if forward else F.max)(F.when(F.col("_side") == 0, edge)).alias("_e"))
        line = Window.partitionBy(*keys).orderBy(F.col("_b").desc() if forward else F.col("_b")).rowsBetween(Window.unboundedPreceding, -1)
        per = per.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(parts)], F.last("_e", ignorenulls=True).over(line).getField("_seen").alias("_carry"))
        on = [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(parts)]
        rows = rows.join(per, on, "left").withColumn("_found", F.coalesce("_found", "_carry"))
    if inner:
        rows = rows.where(F.col("_found").isNotNull())
    return rows.select("_row.*", F.col("_found._at").alias(f"asof_{right_time}"), *[F.col(f"_found.{c}").alias(c) for c in columns])


def small(df: DataFrame, most: int = 20_000) -> DataFrame:
    """df as a broadcast table where it has `most` rows at most (a calendar, a market's sessions), else
    df as it is, for a join that the planner chooses.  It is run once, up to that many rows, to know."""
    rows = df.limit(most + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= most else df


def locf_intervals(observations: DataFrame, keys: Sequence[str], available: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """[valid_from, valid_to) by the next availability; the last interval is open (null end)."""
    w = Window.partitionBy(*keys).orderBy(available)
    return observations.withColumn(start, F.col(available)).withColumn(end, F.lead(available).over(w))


def in_interval(time: Column, start: Column, end: Column, closed: bool = False) -> Column:
    """start <= time < end (closed: <= end); a null end is open."""
    upper = time <= end if closed else time < end
    return (time >= start) & (end.isNull() | upper)


def any_key(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], residual: Column) -> DataFrame:
    """Join on key pair 1 OR key pair 2 ...: a union of equi joins, each match once."""
    parts = [left.join(right, (F.col(a) == F.col(b)) & residual) for a, b in pairs]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def missing_from_grid(grid: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Grid points without a fact."""
    return grid.join(facts.select(*keys).distinct(), list(keys), "left_anti")


def common_sample(blocks: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Rows that every block has, without nulls."""
    out = blocks[0]
    for block in blocks[1:]:
        out = out.join(block, list(keys))
    return out.dropna()
