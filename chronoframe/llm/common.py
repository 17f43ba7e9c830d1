"""Shared plumbing of the training-data operators: shared scratch space, lineage cuts, components."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
_own: dict[str, str] = {}
_root: dict[tuple[str, str], str] = {}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this subpackage to the executors' Python workers, once a session."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = os.path.dirname(package)
    path = os.path.join(tempfile.mkdtemp(prefix="chronoframe-"), "chronoframe.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's URI in the shared folder that the session names (spark.checkpoint.dir).

    A folder named without a scheme is one of Hadoop's default file system.  Where none is named, a
    folder of this process's own stands in for it, on a local master only: executors of a cluster
    would each write to their own disks.  All of an application's folders lie in one, which Hadoop's
    file system deletes when the driver ends: results that read them hold until then.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _own.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="chronoframe-scratch-"))
    key = (context.applicationId, base)
    if key not in _root:
        path = context._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/chronoframe-{uuid.uuid4().hex}")
        store = path.getFileSystem(context._jsc.hadoopConfiguration())
        path = store.makeQualified(path)
        store.mkdirs(path)
        store.deleteOnExit(path)
        _root[key] = path.toString()
    return f"{_root[key]}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, uri: str) -> None:
    """Delete a scratch folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def freed(spark: SparkSession):
    """Within it, a finished query's shuffle files are removed at once, by Spark's own setting."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def keep(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df to shared scratch space and read it again: cuts the lineage, survives executors."""
    uri = scratch(df.sparkSession, name)
    with freed(df.sparkSession):
        df.write.parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri), uri


def kept(df: DataFrame, name: str) -> DataFrame:
    return keep(df, name)[0]


def _tidy() -> None:
    import shutil

    for uri in _own.values():
        shutil.rmtree(uri.removeprefix("file://"), ignore_errors=True)


atexit.register(_tidy)


_slot: dict = {}


def only(kind, make):
    """What one operator keeps in a Python worker between tasks.  A worker keeps one such thing: asking
    for another drops it and gives its memory back, so that stages of one job don't pile up their caches."""
    if kind not in _slot:
        if _slot:
            _slot.clear()
            give_back()
        _slot[kind] = make()
    return _slot[kind]


def give_back() -> None:
    """Return freed memory to the system, which the allocators would otherwise hold for later."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def few_keys(rows: DataFrame, key: str, n: int) -> DataFrame:
    """(key,): at most n distinct non-null keys of rows, those with the smallest hashes.

    Keys over a threshold of the hash, set from their approximate number, are left out before any
    shuffle, so that the one task that orders the rest sees about 1.3 n keys at any size.
    """
    keys = rows.select(F.col(key).alias("key")).where("key IS NOT NULL")
    distinct = max(1, keys.agg(F.approx_count_distinct("key", 0.02)).first()[0])
    top = min(1.0, (1.2 * n + 6 * n**0.5 + 20) / distinct)
    h = F.xxhash64("key")
    some = keys.withColumn("h", h).where(F.col("h") <= F.lit(int(-(1 << 63) + top * ((1 << 64) - 1)) if top < 1 else (1 << 63) - 1))
    return some.distinct().orderBy("h", "key").limit(n).select("key")


def parts_for(spark: SparkSession, df: DataFrame, each: int = 64 << 20, most: int = 100_000) -> int:
    """Partitions for a shuffle of df's rows: one for each `each` bytes by the plan's estimate, where it
    has one, and as many as the session's setting at least."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = -(-size // each) if size < 1 << 60 else 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(most, known))


def text_of(column: str | Column) -> Column:
    """The whole text, a null one as an empty one."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def _state(edges: DataFrame) -> tuple:
    """Count and two order-free fingerprints of the links, to see when they stand still."""
    key = F.xxhash64("u", "v")
    row = edges.agg(F.count("*"), F.bit_xor(key), F.sum((key % 1_000_003).cast("long"))).first()
    return tuple(row)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of links (u, v): rows (node, component), component the smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014): every step is a minimum by
    node and a join on it, so no neighbourhood is ever gathered in one place; every round is written
    to shared scratch space and its predecessor is removed.  Nodes without a link to another node
    have no row.  Null ends and loops are ignored; repeated links count once.  Links that still change
    after `rounds` rounds raise: no unfinished components are returned.
    """
    spark = edges.sparkSession
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now, uri = keep(now.where("u <> v").distinct(), "cc")
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # Every link now points from the larger to the smaller node.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after, next_uri = keep(after, "cc")
        after_state = _state(after)
        remove(spark, uri)
        now, uri = after, next_uri
        if after_state == state:
            break
        state = after_state
    else:
        if state[0]:
            remove(spark, uri)
            raise RuntimeError(f"components still change after {rounds} rounds")
    return now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
