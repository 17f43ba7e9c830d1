"""Media payloads in content-defined chunks: a deduplicated chunk store and ordered chunk lists."""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.llm import common

UNIT = 576
CHUNKS, LISTS = "digest binary, size int, data binary", "doc_id long, n_bytes long, recipe binary, digests array<binary>, rid long"
REMEMBERED = 1 << 20  # chunks whose smallest row a task remembers; one forgotten is sent again
FEATURES = "recipe binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


@lru_cache(maxsize=1)
def _gear() -> np.ndarray:
    """256 random words, from a rule: the first four bytes of SHA-256 over the byte's number."""
    return np.array([int.from_bytes(hashlib.sha256(b"gear%d" % b).digest()[:4], "little") for b in range(256)], dtype=np.uint32)


def payload_of(text: str) -> bytes:
    """UTF-8 bytes filled up with 255 to a positive multiple of the unit."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def cuts(payload: bytes, least: int = 2048, bits: int = 13, most: int = 32_768, block: int = 1 << 22) -> list[int]:
    """Ends of the payload's chunks.

    The rolling gear hash of the last 32 bytes is h = (h << 1) + gear[byte] in 32 bits; a chunk of
    `least` bytes or more ends where its top `bits` bits are zero, and at `most` bytes at the latest.
    The hash of all positions comes from five doubling steps over a block of bytes.
    """
    n = len(payload)
    if n <= least:
        return [n]
    found = []
    for at in range(0, n, block):
        begin = max(0, at - 31)
        h = _gear()[np.frombuffer(payload, np.uint8, min(n, at + block) - begin, begin)]
        for width in (1, 2, 4, 8, 16):
            h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        found.append(np.flatnonzero((h >> np.uint32(32 - bits)) == 0)[...] + begin + 1)
        if begin < at:
            found[-1] = found[-1][found[-1] > at]
    marks, ends, start, k = np.concatenate(found), [], 0, 0
    while n - start > least:
        k = int(np.searchsorted(marks, start + least))
        end = min(int(marks[k]) if k < len(marks) else n, start + most, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def chunks_of(payload: bytes) -> list[bytes]:
    ends = cuts(payload)
    return [payload[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def recipe_of(digests: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(digests)).digest()


#: A chunk in more payloads than this is dealt over several tasks when payloads are rebuilt.
SHARED, HOT_CHUNKS = 5_000, 50_000
#: Rounds in which chunks are sent and stored.
ROUNDS = 2


def ranges_of(rounds: int) -> list[tuple[bytes, bytes]]:
    """Ranges (from, below) of digests, one for each round: together all digests, each half its predecessor.

    A round needs twice its share, shuffled and stored, beside what is stored already: with halves the
    need is the same in all rounds, 2 / (2 - 2 ** (1 - rounds)) of all chunks instead of 2.
    """
    ends = [((1 << rounds) - (1 << rounds - k)) * ((1 << 32) - 1) // ((1 << rounds) - 1) for k in range(1, rounds)]
    marks = [b"", *(e.to_bytes(4, "big") for e in ends), b"\xff" * 33]
    return list(zip(marks, marks[1:]))


def _texts(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of("text").alias("text"))
    return rows.withColumn("rid", F.xxhash64("doc_id", "text"))


@dataclass(frozen=True)
class Store:
    """Where a chunk table and its lists lie, and by how many buckets the table is dealt."""

    path: str
    buckets: int

    def chunks(self, spark: SparkSession) -> DataFrame:
        """(digest, size, data), each digest once, bucketed by digest.  The name in the catalog that
        Spark needs to know of the buckets is given up at once; the files stay."""
        name = f"chunks_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {name} ({CHUNKS}) USING parquet CLUSTERED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/chunks'")
        try:
            return spark.table(name)
        finally:
            spark.sql(f"DROP TABLE {name}")

    def lists(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(LISTS).parquet(f"{self.path}/lists")


def write(docs: DataFrame, path: str, level: int = 9, earlier: Store | None = None) -> Store:
    """Store the payloads of docs(doc_id, text) under path: a chunk table, each distinct chunk once,
    and a list of chunk digests for each row.

    Digests are SHA-256 over a chunk's bytes; a stored chunk is one Zstandard frame.  First the lists
    are written.  A join decides which row brings a chunk: its owner is the row with the smallest hash
    of those that hold it.  A task sends a chunk when a row comes that could be its owner, seen from
    there; the chunks that more than one in HOT_CHUNKS of all uses name, so HOT_CHUNKS chunks at most, are
    held against their owner before they leave, all others where they meet.  Rows equal in doc_id and
    text have equal hashes: what they bring twice is made distinct.  With `earlier`, chunks that store
    already has are left out by an anti join, for the caller to union its chunk table.  The chunk table
    is bucketed by digest, a bucket for each 64 MB of input and as many as the session's shuffle
    partitions at least: later joins on it don't move its bytes.

    Chunks are sent and stored in ROUNDS rounds by ranges of their digests, and a round's shuffle is
    removed before the next: with two rounds disk holds 4/3 of the stored bytes at most, not twice
    them.  Each round cuts all texts again and compresses the chunks of its range only.

    Null and empty texts are one unit of bytes 255.  Very long texts are cut whole, a task holding one
    at a time.  Repeated rows and null doc_ids have lists each.  An empty table gives an empty store.
    Other columns, those named like a result's too, are ignored.
    """
    spark = docs.sparkSession
    common.ship(spark)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, own = [], [], []
            for text in batch.column(1):
                payload = payload_of(t := text.as_py())
                digests = [hashlib.sha256(c).digest() for c in chunks_of(payload)]
                n.append(len(t.encode("utf-8", "surrogatepass")))
                keys.append(recipe_of(digests))
                own.append(digests)
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(own, pa.list_(pa.binary())), batch.column(2)], names=["doc_id", "n_bytes", "recipe", "digests", "rid"])

    def sender(low: bytes, high: bytes):
        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import zstandard

            compress, least = zstandard.ZstdCompressor(level=level).compress, {}
            for batch in batches:
                out, size = [], 0
                for text, rid in zip(batch.column(1), batch.column(2).to_pylist()):
                    for chunk in chunks_of(payload_of(text.as_py())):
                        digest = hashlib.sha256(chunk).digest()
                        if low <= digest < high and rid < least.get(digest[:16], 1 << 63):
                            if len(least) >= REMEMBERED:
                                least.clear()
                            least[digest[:16]] = rid
                            out.append((digest, len(chunk), compress(chunk), rid))
                            size += len(out[-1][2])
                    if size > 4 << 20:
                        yield _chunk_batch(out)
                        out, size = [], 0
                if out:
                    yield _chunk_batch(out)

        return send

    buckets = common.parts_for(spark, docs)
    texts, store = _texts(docs), Store(path, buckets)
    texts.mapInArrow(lists, LISTS).write.parquet(f"{path}/lists")
    uses = store.lists(spark).agg(F.sum(F.size("digests"))).first()[0] or 0
    name = f"chunks_{uuid.uuid4().hex}"
    try:
        for low, high in ranges_of(ROUNDS):
            held = store.lists(spark).select("rid", F.explode("digests").alias("digest")).where((F.col("digest") >= F.lit(low)) & (F.col("digest") < F.lit(high)))
            owners = held.groupBy("digest").agg(F.min("rid").alias("rid"), F.count("*").alias("rows"))
            hot = owners.where(F.col("rows") > max(SHARED, uses // HOT_CHUNKS)).select("digest", F.col("rid").alias("owner"))  # HOT_CHUNKS rows at most
            sent = texts.mapInArrow(sender(low, high), f"{CHUNKS}, rid long").join(F.broadcast(hot), "digest", "left").where("owner IS NULL OR owner = rid").drop("owner")
            # The filter keeps the count in this plan: `hot` and `owned` then share one shuffle of the lists.
            owned = owners.where("rows > 0").select(F.col("digest").alias("_digest"), F.col("rid").alias("_least")).repartition(buckets, "_digest").hint("shuffle_hash")
            # Joined by digest alone, as the rows are dealt: no row has less than the owner's hash.
            mine = sent.repartition(buckets, "digest").join(owned, (F.col("digest") == F.col("_digest")) & (F.col("rid") <= F.col("_least")), "left_semi").drop("rid").dropDuplicates(["digest"])
            if earlier:
                mine = mine.join(earlier.chunks(spark).select("digest"), "digest", "left_anti")
            with common.freed(spark):
                mine.write.mode("append").bucketBy(buckets, "digest").option("path", f"{path}/chunks").option("compression", "uncompressed").saveAsTable(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return store


def _chunk_batch(rows: list[tuple[bytes, int, bytes, int]]) -> pa.RecordBatch:
    digest, size, data, rid = zip(*rows)
    return pa.record_batch([pa.array(digest, pa.binary()), pa.array(size, pa.int32()), pa.array(data, pa.binary()), pa.array(rid, pa.int64())], names=["digest", "size", "data", "rid"])


class _Media:
    """What is known of one payload while its chunks come in order."""

    def __init__(self, recipe: bytes):
        self.recipe, self.digests, self.counts = recipe, hashlib.sha256(), np.zeros(256, np.int64)
        self.payload, self.media, self.size, self.stored, self.tail = hashlib.sha256(), hashlib.sha256(), 0, 0, b""

    def add(self, digest: bytes, data: bytes, unpack) -> None:
        chunk = unpack(data)
        if hashlib.sha256(chunk).digest() != digest:
            raise ValueError("a stored chunk differs from its digest")
        self.digests.update(digest)
        self.payload.update(chunk)
        self.media.update(data)
        self.size, self.stored, self.tail = self.size + len(chunk), self.stored + len(data), (self.tail + chunk[-32:])[-32:]
        self.counts += np.bincount(np.frombuffer(chunk, np.uint8), minlength=256)

    def row(self) -> tuple:
        if self.digests.digest() != self.recipe:
            raise ValueError("a payload's chunks differ from its list")
        values, n = np.arange(256), self.size
        total, squares = int(self.counts @ values), int(self.counts @ (values * values))
        some = self.counts[self.counts > 0] / n
        entropy = math.fsum(-p * math.log2(p) for p in some.tolist())
        feature = f"mean={total / n:.6f};rms={math.sqrt(squares / n):.6f};entropy={entropy:.6f};samples={n}"
        return self.recipe, n, self.payload.hexdigest(), zlib.crc32(self.tail), self.stored, self.media.hexdigest(), feature


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (recipe, pos, digest, data), a recipe's rows in order and together."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    now: _Media | None = None
    names, types = [f.strip().split(" ")[0] for f in FEATURES.split(",")], [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    rows: list[tuple] = []
    for batch in batches:
        for recipe, digest, data in zip(batch.column(0), batch.column(2), batch.column(3)):
            key = recipe.as_py()
            if now is None or now.recipe != key:
                if now:
                    rows.append(now.row())
                now = _Media(key)
            now.add(digest.as_py(), data.as_py(), unpack)
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
            rows = []
    if now:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(now.row()), types)], names=names)


def read(spark: SparkSession, store: Store) -> DataFrame:
    """Rebuild every distinct payload from stored chunks, check it, and give its features by row.

    Payloads with one chunk are rebuilt where the chunk lies; only those of several chunks move, each
    distinct list once however many rows have it.  A chunk of over SHARED payloads is copied for each
    SHARED of them, and their parts are dealt over the copies.
    """
    common.ship(spark)
    chunks, lists = store.chunks(spark), store.lists(spark)
    recipes = common.kept(lists.select("recipe", "digests").groupBy("recipe").agg(F.first("digests").alias("digests")), "recipes")
    parts = recipes.select("recipe", F.size("digests").alias("n"), F.posexplode("digests").alias("pos", "digest"))
    columns = ["recipe", "pos", "digest", F.coalesce("data", F.raise_error(F.lit("a chunk is missing")).cast("binary")).alias("data")]
    one = parts.where("n = 1").join(chunks, "digest", "left").select(*columns).mapInArrow(_rebuild, FEATURES)
    several = parts.where("n > 1")
    shared = several.groupBy("digest").agg(F.ceil(F.count("*") / SHARED).cast("int").alias("copies")).where("copies > 1")
    several = several.join(shared, "digest", "left")
    plain = several.where("copies IS NULL").join(chunks, "digest", "left").select(*columns)
    copied = chunks.join(shared, "digest").select("digest", "data", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    dealt = several.where("copies IS NOT NULL").withColumn("copy", F.pmod(F.xxhash64("recipe", "pos"), F.col("copies")).cast("int"))
    spread = dealt.join(copied, ["digest", "copy"], "left").select(*columns)
    more = plain.unionByName(spread).repartition("recipe").sortWithinPartitions("recipe", "pos").mapInArrow(_rebuild, FEATURES)
    return lists.select("doc_id", "n_bytes", "recipe").join(one.unionByName(more), "recipe").drop("recipe")
