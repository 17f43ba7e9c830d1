"""Quality classifier: random-indexing word vectors, pooled, a small network, calibrated scores."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm import common

WORDS, SIZE, NONZERO, SLICES = 8192, 64, 4, 64
#: Words that stand for what a word looks like; their numbers follow the gap's, 0.
GAP, UPPER, TITLE, MIXED, DIGITS, REPEAT, FIRST = range(7)


@lru_cache(maxsize=1)
def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Each word's sparse random index vector: positions and signs of its entries.  The gap has none."""
    random = np.random.default_rng(20_240_501)
    places = np.argsort(random.random((WORDS, SIZE)), axis=1)[:, :NONZERO].astype(np.int64)
    signs = random.choice(np.array([-1, 1], np.int64), (WORDS, NONZERO))
    signs[GAP] = 0
    return places, signs


def _hashed(word: str) -> int:
    return FIRST + zlib.crc32(word.encode("utf-8", "surrogatepass")) % (WORDS - FIRST)


class Words(dict):
    """White-space-delimited piece -> its words' numbers as bytes; at most `most` entries.

    A run of letters is its lower-cased word and a word for capitals, a run of digits the word for
    digits, a run of anything else the word of these marks.
    """

    def __init__(self, most: int = 200_000):
        import regex

        super().__init__()
        self.most, self.split = most, regex.compile(r"\p{L}+|\p{N}+|[^\p{L}\p{N}]+").findall

    def __missing__(self, piece: str) -> bytes:
        numbers = []
        for run in self.split(piece):
            if run[0].isalpha():
                numbers.append(_hashed(run.lower()))
                if not run.islower():
                    numbers.append(UPPER if run.isupper() and len(run) > 1 else TITLE if run[1:].islower() or len(run) == 1 else MIXED)
            else:
                numbers.append(DIGITS if run[0].isnumeric() else _hashed(run))
        if len(self) >= self.most:
            self.clear()
        value = self[piece] = np.array(numbers, "<i4").tobytes()
        return value

    def of(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


def worker_words() -> Words:
    return common.only("quality words", Words)


def _blocks(batches: Iterator[pa.RecordBatch], column: int, most: int = 500_000) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with the rows' words, about `most` of them at a time."""
    words = worker_words()
    for batch in batches:
        at, held, size = 0, [], 0
        for k, text in enumerate(batch.column(column)):
            held.append(words.of(text.as_py()))
            size += len(held[-1]) // 4
            if size >= most:
                yield batch.slice(at, len(held)), held
                at, held, size = k + 1, [], 0
        if held:
            yield batch.slice(at, len(held)), held


def contexts(docs: DataFrame, window: int = 2) -> np.ndarray:
    """Sum of the index vectors of the words up to `window` away, by word, over all of docs(text).

    A task sends its sums in slices of words; slices of all tasks are added as they come.  What
    reaches the driver is one table of fixed size.
    """
    common.ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        total, gap = np.zeros(WORDS * SIZE), np.zeros(window, "<i4").tobytes()
        for _, held in _blocks(batches, 0, 1_200_000):
            ids = np.frombuffer(gap.join(held), "<i4").astype(np.int64)
            for k in range(1, window + 1):
                for here, there in ((ids[:-k], ids[k:]), (ids[k:], ids[:-k])):
                    base = here * SIZE
                    for j in range(NONZERO):
                        total += np.bincount(base + places[there, j], weights=signs[there, j], minlength=WORDS * SIZE)
        total[GAP * SIZE:(GAP + 1) * SIZE] = 0
        parts = total.astype("<i8").reshape(SLICES, -1)
        some = [k for k in range(SLICES) if parts[k].any()]
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array([zlib.compress(parts[k].tobytes(), 1) for k in some], pa.binary())], names=["slice", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = np.frombuffer(zlib.decompress(packed.as_py()), "<i8")
                sums[k] = sums[k] + values if k in sums else values
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["slice", "sums"])

    schema = "slice int, sums binary"
    texts = docs.select(common.text_of("text").alias("text"))
    table = np.zeros((SLICES, WORDS * SIZE // SLICES))
    for row in texts.mapInArrow(count, schema).repartition("slice").mapInArrow(add, schema).collect():  # SLICES rows
        table[row["slice"]] += np.frombuffer(row["sums"], "<i8")
    return table.reshape(WORDS, SIZE)


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """A word's damped, normalized context and its own index vector, halves of one row."""
    damped = np.sign(sums) * np.sqrt(np.abs(sums))
    damped /= np.maximum(np.linalg.norm(damped, axis=1, keepdims=True), 1e-9)
    places, signs = index_vectors()
    own = np.zeros((WORDS, SIZE))
    np.put_along_axis(own, places, signs / np.sqrt(NONZERO), axis=1)
    return np.hstack([damped, own]).astype(np.float32)


def pooled(held: list[bytes], vectors: np.ndarray, documents: int = 256) -> np.ndarray:
    """Mean word vector by document, with the share of words that repeat one of the two before, and
    the logarithm of the number of words; zeros for documents without words.

    A few documents at a time are counted by word, and the counts are multiplied by the vectors."""
    out = np.zeros((len(held), vectors.shape[1] + 2), np.float32)
    for at in range(0, len(held), documents):
        some = held[at:at + documents]
        n = np.array([len(x) // 4 for x in some])
        if not n.any():
            continue
        ids = np.frombuffer(b"".join(some), "<i4").astype(np.int64)
        row = np.repeat(np.arange(len(some)), n)
        counts = np.bincount(row * WORDS + ids, minlength=len(some) * WORDS).reshape(len(some), WORDS)
        rows, under = slice(at, at + len(some)), np.maximum(n, 1)
        out[rows, :-2] = counts.astype(np.float32) @ vectors / under[:, None]
        same = np.zeros(len(ids), bool)
        for k in (1, 2):
            same[k:] |= (ids[k:] == ids[:-k]) & (ids[k:] >= FIRST) & (row[k:] == row[:-k])
        out[rows, -2] = np.bincount(row, same, len(some)) / under
        out[rows, -1] = np.log1p(n) / 10
    return out


@dataclass
class Network:
    """Two layers; score = sigmoid(logit / temperature)."""

    shift: np.ndarray
    scale: np.ndarray
    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.shift) / self.scale @ self.a + self.b) @ self.c + self.d

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -500, 500)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7, least_steps: int = 1500) -> Network:
    """Adam on the logistic loss over four fifths of the rows; the temperature, by golden-section
    search, has the least loss on the others.  Rows of one class give that class's score throughout;
    no rows give 0.5."""
    width = x.shape[1] if x.ndim == 2 and len(x) else SIZE * 2 + 2
    if not len(y) or y.min() == y.max():
        constant = 0.0 if not len(y) else 6.0 * (2 * float(y[0]) - 1)
        return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), constant, 1.0)
    random = np.random.default_rng(seed)
    order = random.permutation(len(y))
    x, y = x[order].astype(np.float64), y[order].astype(np.float64)
    held = max(1, len(y) // 5)
    xv, yv, x, y = x[:held], y[:held], x[held:], y[held:]
    shift, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = (x - shift) / scale
    p = [random.normal(0, 1 / np.sqrt(width), (width, hidden)), np.zeros(hidden), random.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    size = min(64, len(y))
    for _ in range(max(epochs, -(-least_steps * size // len(y)))):
        order = random.permutation(len(y))
        for at in range(0, len(y) - size + 1, size):
            rows = order[at:at + size]
            h = np.tanh(z[rows] @ p[0] + p[1])
            error = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -500, 500))) - y[rows]) / size
            back = np.outer(error, p[2]) * (1 - h * h)
            grads = [z[rows].T @ back + decay * p[0], back.sum(0), h.T @ error + decay * p[2], np.array([error.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(shift, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    logits = net.logits(xv)
    loss = lambda t: float(np.mean(np.logaddexp(0, logits / np.exp(t)) - yv * logits / np.exp(t)))
    low, high, g = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    net.temperature = float(np.exp((low + high) / 2))
    return net


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> tuple[np.ndarray, Network]:
    """Word vectors from all of docs, a network from a bounded sample of labelled rows.

    At most sample_rows documents with a label of labels(doc_id, quality) outside the held-out third
    (CRC-32 of doc_id as text, modulo 3, is 1) are learnt from, those with the smallest hash of
    doc_id; nothing else bounds them.  A doc_id counts once: of several labels its largest, of several
    texts its smallest.  Null doc_ids and null qualities are left out.  Very long texts are read whole.
    """
    vectors = word_vectors(contexts(docs))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IS NOT NULL")
    known = known.where(~held_out("doc_id"))
    chosen = common.few_keys(known, "doc_id", sample_rows).withColumnRenamed("key", "doc_id")
    known = known.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, held in _blocks(batches, 1):
            x = pooled(held, shared.value)
            yield pa.record_batch([some.column(0), some.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "quality", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of("text").alias("text")).join(F.broadcast(known), "doc_id")
    one = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").alias("quality"))
    got = one.mapInArrow(features, "doc_id long, quality int, x binary").collect()  # sample_rows rows at most
    got.sort(key=lambda r: r.doc_id)
    x = np.array([np.frombuffer(r.x, np.float32) for r in got])
    return vectors, train(x, np.array([int(r.quality > 0) for r in got]))


def held_out(column: str):
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def score(docs: DataFrame, vectors: np.ndarray, net: Network) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text), from the text alone.

    Null and empty texts have the score of a document without words.  Very long texts are read whole,
    half a million words and a document at a time.  Repeated rows and null doc_ids have rows each and,
    with equal texts, equal scores; a null doc_id is not held out.  An empty table gives no rows.  Other
    columns, those named score, held_out or predicted too, are ignored.
    """
    spark = docs.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast((vectors, net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, model = shared.value
        for some, held in _blocks(batches, 1):
            yield pa.record_batch([some.column(0), pa.array(model.scores(pooled(held, own)))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of("text").alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that score below 0.5; all columns as they were."""
    vectors, net = fit(docs, labels)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((vectors, net))
    at, wanted = docs.columns.index("text"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, model = shared.value
        for batch in batches:
            texts = batch.column(at).fill_null("")
            done = 0
            plain = pa.record_batch([texts], names=["text"])
            for some, held in _blocks(iter([plain]), 0):
                good = model.scores(pooled(held, own)) >= 0.5
                yield batch.slice(done, some.num_rows).filter(pa.array(good))
                done += some.num_rows

    return docs.mapInArrow(run, wanted)
