"""WARC archives: records compressed one by one with a Zstandard dictionary that leads the file."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.llm import common

#: Fixed values of the format: the skippable frame that holds a dictionary, Zstandard's frame magic.
DICTIONARY_FRAME, FRAME = 0x184D2A5D, 0xFD2FB528
#: An empty skippable frame: four bytes of magic, 0x184D2A50, and a length of zero.
NOTHING = "P*M\x18\x00\x00\x00\x00"
FRAME_NAMES, FRAME_TYPES = ["page_id", "url", "sha", "n", "frame"], [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
ROW_SCHEMA = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32(sha1: str) -> str:
    """A digest's hex digits in base 32."""
    return base64.b32encode(bytes.fromhex(sha1)).decode()


def base32_sha1(payload: bytes) -> str:
    return base32(hashlib.sha1(payload).hexdigest())


def train(samples: list[bytes], size: int = 65_536) -> bytes:
    """A dictionary of these records; too few to train on: their own bytes as a raw one."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size]


def _dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw) if raw else None


def _line(value: str) -> str:
    """A header value on one line: control characters and spaces percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(page_id: int | None, url: str | None, payload: bytes | None, refers_to: int | None, date: str, n: int = 0, sha: str = "") -> bytes:
    """One response record, or, with refers_to, one revisit record without the payload itself: its
    length and the hex digits of its SHA-1 are enough."""
    if payload is not None:
        n, sha = len(payload), hashlib.sha1(payload).hexdigest()
    digest, name = base32(sha), "" if page_id is None else str(page_id)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{name}:{digest}')}>", f"WARC-Date: {date}",
            f"WARC-Target-URI: {_line(url) if url else f'urn:page:{name}'}", f"WARC-Payload-Digest: sha1:{digest}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if not url:
        head.append("X-No-URL: 1")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{refers_to}:{digest}')}>", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _kinds(rows: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, sha, first) of the rows(page_id, sha, n) that revisit another, each once.

    Rows are made distinct before they meet their first: what the join gives is dealt by another key
    afterwards, so a digest that many pages have may be split over tasks.
    """
    long = rows.where(F.col("n") >= min_bytes).select("page_id", "sha").distinct()
    first = long.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 AND first IS NOT NULL")
    return long.join(first.select("sha", "first"), "sha").where("NOT (page_id <=> first)")


def write(pages: DataFrame, path: str, min_bytes: int = 0, dictionary_bytes: int = 65_536, sample_records: int = 1000,
          sample_bytes: int = 8 << 20, level: int = 3, file_bytes: int = 8 << 20, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write pages(page_id, url, html) to WARC files, compressed with Zstandard, at path.

    The dictionary is trained on whole records of at most sample_records rows, one of each page_id with
    the smallest hashes, up to sample_bytes; it leads each file in a skippable frame.  Records are
    compressed one by one where their page is read, and only their frames move: each to the task that
    knows whether it is a revisit.  A frame whose payload that task's reader has seen under a smaller
    page_id is not sent.  Files roll at file_bytes and are written by Spark's text writer: binary rows
    of a whole archive each, one a file (part-*.txt), behind each an empty skippable frame in place of
    an end of line.  Its commit protocol and Hadoop's file systems hold for them, so retried or doubled
    tasks leave no second copy and any path that Spark reads can be written.

    Of rows with equal payloads of min_bytes or more, those with the smallest page_id are responses,
    the others revisits of it; shorter ones are all responses.  Null html is an empty payload.  A row
    without page_id is a revisit where a numbered one has its payload, else a response.  Repeated
    rows are records each.  A record longer than file_bytes has a file of its own.  An empty table gives
    no archives.  Other columns, those named like a record's fields too, are ignored.
    """
    spark = pages.sparkSession
    common.ship(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), common.text_of("html").cast("binary").alias("payload"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples, size = [], 0
        for batch in batches:
            for page_id, url, payload in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if size < sample_bytes:
                    samples.append(record(page_id, url, payload, None, date))
                    size += len(samples[-1])
        yield pa.record_batch([pa.array([train(samples, dictionary_bytes)], pa.binary())], names=["dictionary"])

    chosen = common.few_keys(rows, "page_id", sample_records).withColumnRenamed("key", "page_id")
    sample = rows.join(F.broadcast(chosen), "page_id").groupBy("page_id").agg(F.min(F.struct("payload", "url")).alias("r"))
    sample = sample.orderBy(F.xxhash64("page_id"), "page_id").limit(sample_records).select("page_id", "r.url", "r.payload")
    learnt = sample.mapInArrow(learn, "dictionary binary").collect()
    raw = spark.sparkContext.broadcast(bytes(learnt[0][0]) if learnt else b"")

    def squeeze():
        import zstandard

        own = _dictionary(raw.value)
        if own:
            own.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=own).compress

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress, most = squeeze(), 4 << 20
        for batch in batches:
            ids, digests = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            least: dict = {}
            for page_id, sha in zip(ids, digests):
                if page_id is not None and page_id < least.get(sha, 1 << 63):
                    least[sha] = page_id
            out, size = [], 0
            for k, (url, payload) in enumerate(zip(batch.column(1), batch.column(2))):
                payload = payload.as_py()
                again = len(payload) >= min_bytes and digests[k] in least and (ids[k] is None or ids[k] > least[digests[k]])
                frame = None if again else compress(record(ids[k], url.as_py(), payload, None, date))
                out.append((ids[k], url.as_py(), digests[k], len(payload), frame))
                size += len(frame or b"")
                if size > most:
                    yield _batch(out, FRAME_NAMES, FRAME_TYPES)
                    out, size = [], 0
            if out:
                yield _batch(out, FRAME_NAMES, FRAME_TYPES)

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = squeeze()
        lead = struct.pack("<II", DICTIONARY_FRAME, len(raw.value)) + raw.value
        held, some = io.BytesIO(), False
        for batch in batches:
            for page_id, url, sha, n, frame, first in zip(*(batch.column(c) for c in range(6))):
                if first.is_valid:
                    data = compress(record(page_id.as_py(), url.as_py(), None, first.as_py(), date, n.as_py(), sha.as_py()))
                else:
                    data = frame.as_py()
                if some and held.tell() + len(data) > file_bytes:
                    yield pa.record_batch([pa.array([held.getvalue()], pa.binary())], names=["archive"])
                    held, some = io.BytesIO(), False
                if not some:
                    held.write(lead)
                    some = True
                held.write(data)
        if some:
            yield pa.record_batch([pa.array([held.getvalue()], pa.binary())], names=["archive"])

    keyed = rows.withColumn("sha", F.sha1("payload"))
    again = _kinds(keyed.select("page_id", "sha", F.octet_length("payload").alias("n")), min_bytes)
    again = again.select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), F.col("first").alias("_first"))
    sent = keyed.mapInArrow(frames, "page_id long, url string, sha string, n long, frame binary")
    joined = sent.join(again, sent.page_id.eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")), "left")
    files = joined.select("page_id", "url", "sha", "n", "frame", "_first").mapInArrow(archive, "archive binary")
    with common.freed(spark):
        files.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", NOTHING).option("maxRecordsPerFile", 1).text(path)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives at path, payloads of responses checked against their digests."""
    common.ship(spark)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from _records(content.as_buffer())

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0")
    return files.select("content").mapInArrow(parse, ROW_SCHEMA)


def _records(content, most: int = 2000) -> Iterator[pa.RecordBatch]:
    import zstandard

    data = memoryview(content)
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_FRAME:
        raise ValueError("an archive must begin with its dictionary")
    unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(bytes(data[8:8 + size])))
    stream = io.BufferedReader(unpack.stream_reader(pa.py_buffer(data[8 + size:]), read_across_frames=True), 1 << 20)
    names = [f.strip().split(" ")[0] for f in ROW_SCHEMA.split(",")]
    types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    rows: list[tuple] = []
    while stream.readline():  # skippable frames between records hold no bytes
        head = {}
        while line := stream.readline().strip():
            name, _, value = line.decode().partition(": ")
            head[name] = value
        body = stream.read(int(head["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where it says")
        http, _, payload = body.partition(b"\r\n\r\n")
        n = int(http.rpartition(b"Content-Length: ")[2])
        kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response" and (len(payload) != n or base32_sha1(payload) != digest):
            raise ValueError(f"a payload differs from its digest {digest}")
        number = lambda key: int(head[key]) if key in head else None
        rows.append((number("X-Page-ID"), None if "X-No-URL" in head else head["WARC-Target-URI"], payload if kind == "response" else None, n, digest, kind, number("X-Refers-To-Page-ID")))
        if len(rows) >= most:
            yield _batch(rows, names, types)
            rows = []
    if rows:
        yield _batch(rows, names, types)
