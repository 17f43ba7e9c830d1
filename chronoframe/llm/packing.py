"""Packing documents into fixed-size sequences, balanced by estimated attention cost."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm import common, tokens

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class _Bins:
    """Sequences by remaining capacity; finds the cheapest one that still has room for n tokens."""

    def __init__(self, capacity: int, linear: float, quadratic: float):
        self.size = 1 << capacity.bit_length()
        self.capacity, self.linear, self.quadratic = capacity, linear, quadratic
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
        self.tree: list[tuple[float, int, int]] = [(np.inf, -1, -1)] * (2 * self.size)  # cost, sequence, room

    def cost(self, n: int) -> float:
        return self.linear * n + self.quadratic * n * n

    def _refresh(self, room: int) -> None:
        heap, tree, at = self.heaps[room], self.tree, room + self.size
        tree[at] = (*heap[0], room) if heap else (np.inf, -1, -1)
        while at > 1:
            at //= 2
            a, b = tree[2 * at], tree[2 * at + 1]
            tree[at] = a if a <= b else b

    def put(self, cost: float, sequence: int, room: int) -> None:
        import heapq

        if room > 0:
            heapq.heappush(self.heaps[room], (cost, sequence))
            self._refresh(room)

    def cheapest(self, n: int) -> tuple[float, int, int]:
        """Cheapest sequence with room for n or more (ties: lowest sequence), taken out; or -1."""
        import heapq

        best, a, b, tree = (np.inf, -1, -1), n + self.size, 2 * self.size, self.tree
        while a < b:
            if a & 1:
                best = min(best, tree[a])
                a += 1
            if b & 1:
                b -= 1
                best = min(best, tree[b])
            a, b = a // 2, b // 2
        if best[1] >= 0:
            heapq.heappop(self.heaps[best[2]])
            self._refresh(best[2])
        return best

    def roomiest(self) -> tuple[float, int, int]:
        for room in range(self.capacity, 0, -1):
            if self.heaps[room]:
                return self.cheapest(room)
        return (np.inf, -1, -1)


def plan(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1.0 / 1024) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths.

    Whole sequences are cut off long documents first.  The rests are taken in descending order, each
    to the sequence of the lowest estimated cost, linear * n + quadratic * n * n summed over its
    pieces, that has room; where none has, the rest is cut over the roomiest sequences.  There are
    just enough sequences for the tokens, so only the last can be short; that one is cut into
    power-of-two sequences, which need no padding.  Ties: the earlier document, the earlier sequence.
    """
    pieces, rests, sequence = [], [], 0
    for doc, n in enumerate(lengths):
        whole = n - n % capacity
        for start in range(0, whole, capacity):
            pieces.append((doc, start, capacity, sequence, 0))
            sequence += 1
        if n > whole:
            rests.append((n - whole, doc, whole))
    total = sum(r[0] for r in rests)
    rooms = [capacity] * (total // capacity) + [1 << k for k in range(capacity.bit_length() - 1, -1, -1) if (total % capacity) >> k & 1]
    bins, used = _Bins(capacity, linear, quadratic), [0] * len(rooms)
    for k, room in enumerate(rooms):
        bins.put(0.0, k, room)
    rests.sort(key=lambda r: (-r[0], r[1]))
    for n, doc, start in rests:
        while n:
            cost, k, room = bins.cheapest(n)
            if k < 0:
                cost, k, room = bins.roomiest()
            take = min(n, room)
            pieces.append((doc, start, take, sequence + k, used[k]))
            used[k] += take
            bins.put(cost + bins.cost(take), k, room - take)
            n, start = n - take, start + take
    return pieces


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 0, vocabulary: str = "byte_bpe_50k.json",
         linear: float = 1.0, quadratic: float = 1.0 / 1024, batch_tokens: int = 4_000_000, cache_entries: int = 500_000) -> DataFrame:
    """Pack docs(doc_id, text) into sequences of `capacity` tokens (a power of two); rows are pieces.

    Each task encodes its documents and balances them over sequences in batches of batch_tokens
    tokens, so that ids are never shuffled and a task holds one batch.  A batch's last short
    sequence is cut into power-of-two sequences: nothing is padded, at any scale.  sequence_id is
    unique: task number, then the sequence's number in the task.

    Null and empty texts are the end id alone.  Null doc_ids are packed too.  Repeated rows are
    packed each.  A text longer than a batch is a batch of its own.  An empty table gives no rows.
    Other columns are ignored.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    spark = docs.sparkSession
    common.ship(spark)
    spec = spark.sparkContext.broadcast(tokens.vocabulary(vocabulary))
    names = [f.strip().split(" ")[0] for f in PIECE_SCHEMA.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end, first = tokens.byte_bpe(spec.value, cache_entries), np.array([end_id], "<i4").tobytes(), TaskContext.get().partitionId() << 32
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def out() -> pa.RecordBatch:
            nonlocal first
            rows = plan([len(x) // 4 for _, x in held], capacity, linear, quadratic)
            crc = [zlib.crc32(memoryview(held[d][1])[4 * s:4 * (s + n)]) for d, s, n, _, _ in rows]
            ids = pa.array([held[r[0]][0] for r in rows], pa.int64())
            column = lambda k: np.array([r[k] for r in rows], dtype=np.int64)
            batch = pa.record_batch([ids, pa.array(column(1)), pa.array(column(2)), pa.array(crc, pa.int64()), pa.array(np.array([len(held[r[0]][1]) // 4 for r in rows], dtype=np.int64)), pa.array(column(3) + first), pa.array(column(4))], names=names)
            first += max(r[3] for r in rows) + 1
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append((doc_id, bpe.encode(text) + end))
                size += len(held[-1][1]) // 4
                if size >= batch_tokens:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of("text").alias("text")).mapInArrow(run, PIECE_SCHEMA)
