"""Sinks: append-if-absent, upsert, versioned replace, staged replace, ledgers, raw landing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.operators.windows import latest


def _fs(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def settle(spark: SparkSession, target: str) -> None:
    """Finish a swap that a crash broke off: without a target, a whole staged folder takes its place,
    else the one put aside does."""
    fs, path = _fs(spark, target)
    if not fs.exists(path):
        for name, sign in (("__staged", "/_SUCCESS"), ("__old", "")):
            _, other = _fs(spark, target + name)
            if fs.exists(_fs(spark, target + name + sign)[1]):
                fs.rename(other, path)
                return


def exists(spark: SparkSession, uri: str) -> bool:
    settle(spark, uri)
    fs, path = _fs(spark, uri)
    return fs.exists(path)


def replace(spark: SparkSession, staged: str, target: str) -> None:
    """Put the staged folder in the target's place by renames; the old one goes last.  A crash in between
    leaves both beside the target's name, and settle(), which every sink and exists() begin with, ends it."""
    fs, new = _fs(spark, staged)
    _, old = _fs(spark, target)
    _, aside = _fs(spark, f"{target}__old")
    fs.delete(aside, True)
    if fs.exists(old):
        fs.rename(old, aside)
    fs.rename(new, old)
    fs.delete(aside, True)


def append_absent(rows: DataFrame, target: str, keys: Sequence[str], batch_id: int | None = None) -> int:
    """Append rows whose key is not in the target; returns how many.  Of rows with one key the first
    by all columns goes in.  With a batch id, a batch that is repeated after a failure replaces itself."""
    spark = rows.sparkSession
    fresh = latest(rows, keys, [F.col(c).asc_nulls_last() for c in rows.columns])
    if exists(spark, target):
        held = spark.read.option("recursiveFileLookup", "true").schema(rows.schema).parquet(target)
        if batch_id is not None:
            held = held.where(~F.col("_metadata.file_path").contains(f"/_batch={batch_id}/"))
        fresh = fresh.join(held.select(*keys), list(keys), "left_anti")
    fresh = fresh.persist()
    n = fresh.count()
    if batch_id is not None:
        fresh.write.mode("overwrite").parquet(f"{target}/_batch={batch_id}")
    elif n:
        fresh.write.mode("append").parquet(target)
    fresh.unpersist()
    return n


def upsert(rows: DataFrame, target: str, keys: Sequence[str], order: str) -> None:
    """Last row of each key by `order` wins over what the target holds; staged, then swapped."""
    spark = rows.sparkSession
    both = rows.withColumn("_new", F.lit(1))
    if exists(spark, target):
        both = both.unionByName(spark.read.parquet(target).withColumn("_new", F.lit(0)), allowMissingColumns=True)
    won = latest(both, keys, [F.col(order).desc_nulls_last(), F.col("_new").desc()]).drop("_new")
    won.write.mode("overwrite").parquet(f"{target}__staged")
    replace(spark, f"{target}__staged", target)


def replace_version(rows: DataFrame, target: str, version: str = "calculation_version") -> None:
    """Replace the partitions of the versions that rows hold; others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(version).parquet(target)


def staged_replace(rows: DataFrame, target: str, keys: Sequence[str]) -> int:
    """Write aside, check that keys are unique, then swap; a failed check leaves the target alone."""
    spark = rows.sparkSession
    stage = f"{target}__staged"
    rows.write.mode("overwrite").parquet(stage)
    held = spark.read.parquet(stage)
    n, distinct = held.agg(F.count("*"), F.count_distinct(F.struct(*keys))).first()
    if n != distinct:
        raise ValueError(f"{n - distinct} rows repeat a key of {target}")
    replace(spark, stage, target)
    return n


def land_raw(payloads: DataFrame, target: str) -> DataFrame:
    """Immutable content-addressed landing of a text column `payload`: rows whose hash is new are
    appended under the hash's first two digits.  Returns the payloads with their hashes."""
    spark = payloads.sparkSession
    hashed = payloads.withColumn("content_hash", F.sha2("payload", 256)).withColumn("hash_prefix", F.substring("content_hash", 1, 2))
    fresh = latest(hashed, ["content_hash"], [F.col(c).asc_nulls_last() for c in payloads.columns])
    if exists(spark, target):
        fresh = fresh.join(spark.read.parquet(target).select("content_hash"), "content_hash", "left_anti")
    fresh.write.mode("append").partitionBy("hash_prefix").parquet(target)
    return hashed


def land_timestamped(payloads: DataFrame, target: str, retrieved: str, source: str) -> DataFrame:
    """Immutable landing by time: payloads(payload, ...) go under their source and retrieval time (UTC, text
    yyyymmddThhmmss), each with its hash.  A time that a source already has is refused, so nothing that
    was landed is ever written over."""
    spark, place = payloads.sparkSession, f"{target}/source={source}/retrieved={retrieved}"
    if _fs(spark, place)[0].exists(_fs(spark, place)[1]):
        raise ValueError(f"{place} is already landed")
    hashed = payloads.withColumn("content_hash", F.sha2("payload", 256))
    hashed.write.parquet(place)
    return hashed


class Ledger:
    """Append-only run records: a run id is a hash of version and inputs, and a completed run is
    found again instead of being done again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def record(self, run_id: str, status: str, received: int = 0, inserted: int = 0) -> None:
        row = self.spark.createDataFrame([(run_id, status, received, inserted)], "run_id string, status string, received long, inserted long")
        row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(self.path)

    def completed(self, run_id: str) -> bool:
        if not exists(self.spark, self.path):
            return False
        return bool(self.spark.read.parquet(self.path).where((F.col("run_id") == run_id) & (F.col("status") == "completed")).take(1))

    def run(self, run_id: str, work) -> bool:
        """Do the work unless the run is complete; returns whether it was done."""
        if self.completed(run_id):
            return False
        self.record(run_id, "started")
        try:
            n = work()
        except Exception:
            self.record(run_id, "failed")
            raise
        self.record(run_id, "completed", inserted=n or 0)
        return True
