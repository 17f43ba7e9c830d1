"""Token-ID output: ORC files of whole documents' token ids, in ascending document order."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoframe.llm import common, tokens

FILE_SCHEMA = "doc_id long, part int, pos long, n_tokens long, tokens array<int>"


def list_array(parts: list[bytes]) -> pa.ListArray:
    """Little-endian int32 byte strings as one Arrow list column."""
    ends = np.cumsum([0, *(len(p) // 4 for p in parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), dtype="<i4")))


def write(docs: DataFrame, path: str, end_id: int = 2, vocabulary: str = "byte_bpe_50k.json",
          bloom_fpp: float = 0.01, row_index_stride: int = 10_000, stripe_bytes: int = 64 << 20) -> None:
    """Write (doc_id, part, pos, n_tokens, tokens) rows of docs(doc_id, text) to ORC files at path.

    Documents are range-partitioned by doc_id before they are encoded, so texts cross the network
    once and ids never; every file holds a contiguous id range in ascending order.  ORC gives the
    run-length encoded integer streams, a row index each `row_index_stride` rows, Bloom filters on
    doc_id, and stripes that readers take in parallel and skip by their statistics.
    part is the file's ordinal, pos the ids before the document in its file.

    Null and empty texts hold end_id alone; very long ones are encoded whole, as one list.  There is a
    file for each 64 MB of input, and as many as the session's shuffle partitions at least.  Null doc_ids
    come first.  Rows of one doc_id follow each
    other by their texts' hash, over several files if need be; each is a document.  An empty table
    gives files without rows.  Other columns are not written, whatever their names.
    """
    spark = docs.sparkSession
    common.ship(spark)
    spec = spark.sparkContext.broadcast(tokens.vocabulary(vocabulary))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end, pos, part = tokens.byte_bpe(spec.value), np.array([end_id], "<i4").tobytes(), 0, TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                ids = [bpe.encode(t) + end for t in some.column(1).to_pylist()]
                n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                before = pos + np.cumsum(n) - n
                pos += int(n.sum())
                yield pa.record_batch([some.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(before), pa.array(n), list_array(ids)], names=["doc_id", "part", "pos", "n_tokens", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of("text").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(common.parts_for(spark, docs), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    (rows.mapInArrow(encode, FILE_SCHEMA).write.option("compression", "zstd")
     .option("orc.create.index", "true").option("orc.row.index.stride", str(row_index_stride))
     .option("orc.stripe.size", str(stripe_bytes))
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", str(bloom_fpp)).orc(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows; filters on doc_id prune files, stripes and row groups by their metadata."""
    return spark.read.schema(FILE_SCHEMA).orc(path)


def digests(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files' rows."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(4)
            offsets, values = ids.offsets.to_numpy(), memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<i4")).cast("B")
            sums = [zlib.crc32(values[4 * a:4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())], names=["doc_id", "part", "pos", "n_tokens", "ids_crc32"])

    common.ship(files.sparkSession)
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("part", F.coalesce(before, F.lit(0)).alias("base"))  # a row a file, 100,000 at most
    each = files.select("doc_id", "part", "pos", "n_tokens", "tokens")
    each = each.mapInArrow(crc, "doc_id long, part int, pos long, n_tokens long, ids_crc32 long")
    return each.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("pos")).alias("start"), "n_tokens", "ids_crc32")
