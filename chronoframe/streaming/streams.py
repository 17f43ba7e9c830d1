"""Structured Streaming operators: windows, sessions, first-seen rows, story state, ingestion."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def source(spark: SparkSession, path: str, schema, files_a_trigger: int | None = None, fmt: str = "parquet") -> DataFrame:
    """Landed files as a stream; files_a_trigger is the request budget of one micro-batch."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_a_trigger:
        reader = reader.option("maxFilesPerTrigger", files_a_trigger)
    return reader.load(path)


def _instant(stream: DataFrame, time: str, lateness: str) -> DataFrame:
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)


def tumbling(stream: DataFrame, time: str, width: str, keys: Sequence[str], lateness: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts and sums of `value` by key and window; rows later than the watermark allows are dropped
    once a window is closed."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    out = _instant(stream, time, lateness).groupBy(*keys, window.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def sessions(stream: DataFrame, time: str, gap: str, key: str, lateness: str = "1 day") -> DataFrame:
    """Sessions of a key: rows less than `gap` apart."""
    out = _instant(stream, time, lateness).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(stream: DataFrame, time: str, keys: Sequence[str], lateness: str) -> DataFrame:
    """Each key's first row within the watermark."""
    return _instant(stream, time, lateness).dropDuplicatesWithinWatermark(list(keys))


def story_state(stream: DataFrame, key: str, time: str, source_column: str) -> DataFrame:
    """Updates, distinct sources and first report of each story, kept in custom state."""

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        updates, first, seen = state.get if state.exists else (0, None, [])
        seen = set(seen)
        for f in frames:
            updates += len(f)
            low = f["ts"].min().value // 1000
            first = low if first is None else min(first, low)
            seen |= {int(s) for s in f["source"]}
        state.update((updates, first, sorted(seen)))
        yield pd.DataFrame({"story": [name[0]], "updates": [updates], "sources": [len(seen)], "first_report": [pd.Timestamp(first * 1000)]})

    rows = stream.select(F.col(key).alias("story"), F.col(time).cast("timestamp").alias("ts"), F.col(source_column).cast("long").alias("source"))
    return rows.groupBy("story").applyInPandasWithState(step, "story string, updates long, sources long, first_report timestamp", "updates long, first long, seen array<long>", "update", GroupStateTimeout.NoTimeout)


def ingest(stream: DataFrame, target: str, checkpoint: str, keys: Sequence[str]) -> None:
    """Append rows whose key the target doesn't hold yet, batch by batch, exactly once after a restart."""

    def write(batch: DataFrame, number: int) -> None:
        from chronoframe.sources.sinks import append_absent

        append_absent(batch, target, keys, batch_id=number)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def shared(spark, name: str) -> str:
    """A folder's URI in the shared folder that the session names; on a local master one of this process's
    own will do where none is named, on a cluster it would not be seen by others."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="chronoframe-stream-")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name}")
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    path = store.makeQualified(path)
    store.mkdirs(path)
    store.deleteOnExit(path)
    return path.toString()


def drained(tables, name: str, plan: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """All results of a streaming plan over a table's files: written by file sink in append mode,
    otherwise batch by batch, and read again."""
    spark = tables.spark
    batch = tables(name)
    root = shared(spark, f"stream-{uuid.uuid4().hex}")
    landed = f"{root}/in"
    batch.write.parquet(landed)
    # A closing row far ahead moves the watermark past every open window; it is left out again.
    stream = source(spark, landed, spark.read.parquet(landed).schema)
    out = plan(stream)
    if mode == "append":
        late = spark.read.parquet(landed).orderBy(F.col("ts").desc()).limit(1).withColumn("ts", F.col("ts") + F.expr("INTERVAL 3650 DAYS"))
        late = late.select(*[F.lit(-1).cast(t).alias(c) if c == "user_id" else F.col(c) for c, t in late.dtypes])
        run = lambda: out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
        run()
        late.write.mode("append").parquet(landed)
        run()
        return spark.read.schema(out.schema).parquet(f"{root}/out").where("user_id <> -1")

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    out.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).option("recursiveFileLookup", "true").parquet(f"{root}/out")
