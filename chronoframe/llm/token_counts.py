"""Token counts by map-side lookup of pre-token lengths."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm import common, tokens


def frequent_pieces(docs: DataFrame, entries: int = 8192, held: int = 1 << 18) -> DataFrame:
    """(piece, n): the `entries` most frequent pieces between white space, counted over all documents.

    A task counts whole texts in one table; where it grows past `held` pieces, the rarer half goes.  It
    sends its `entries` most frequent ones, so what is summed by piece is a bounded list a task, never
    the pre-tokens themselves.  Pieces under one in 16 * entries of all are left out before the rest is
    ordered, so at most that many are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(text.split())
            if len(seen) > held:
                seen = Counter(dict(seen.most_common(held // 2)))
        best = [x for x in seen.most_common(entries) if len(x[0]) <= 64]
        yield pa.record_batch([pa.array([w for w, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], names=["piece", "n"])

    found = docs.select(common.text_of("text").alias("text")).mapInArrow(run, "piece string, n long")
    found = common.kept(found.groupBy("piece").agg(F.sum("n").alias("n")), "pieces")
    total = found.agg(F.sum("n")).first()[0] or 0
    return found.where(F.col("n") * 16 * entries >= total).orderBy(F.col("n").desc(), "piece").limit(entries)


def frequent_lengths(docs: DataFrame, spec, entries: int = 8192) -> dict[str, int]:
    """The broadcast tier: token lengths of the pre-tokens of the most frequent pieces, at most
    `entries` of them.  Counts do not depend on it."""
    counts, seen = tokens.WordCounts(spec.value, {}), Counter()
    for r in frequent_pieces(docs, entries).collect():  # `entries` rows
        for word in counts.pre_tokens(r.piece) or ():
            seen[word] += r.n
    return {w: counts.words[w] for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:entries]}


def count(docs: DataFrame, limit: int = 2048, vocabulary: str = "word_bpe_49k.json", entries: int = 8192) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs(doc_id, text).

    Two tiers, no shuffle: a broadcast table of frequent pre-token lengths, and each worker's bounded
    cache, filled by the library's own model.  Special strings, and characters whose normalization
    only the library knows, send the whole text through the library.

    Null and empty texts have 0 bytes and 0 tokens.  Very long texts are counted whole.  Repeated rows
    and null doc_ids have a row each.  An empty table gives no rows.  Other columns, those named
    n_bytes, n_tokens or over_limit too, are ignored.
    """
    spark = docs.sparkSession
    common.ship(spark)
    spec = spark.sparkContext.broadcast(tokens.vocabulary(vocabulary))
    table = spark.sparkContext.broadcast(frequent_lengths(docs, spec, entries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _counter(spec, table)
        for batch in batches:
            n = [own.count(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of("text").alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)


def _counter(spec, table) -> tokens.WordCounts:
    """One counter a worker process, broadcast table and vocabulary."""
    key = hash((spec.value[:200], len(spec.value), tuple(sorted(table.value.items())[:50]), len(table.value)))
    return common.only(("word counts", key), lambda: tokens.WordCounts(spec.value, table.value))
