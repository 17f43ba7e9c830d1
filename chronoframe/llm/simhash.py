"""SimHash near-duplicates: fingerprints of whole texts, linked through anchor points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoframe.llm import common

BITS, HALF, THRESHOLD, BLOCK, CROWDS = 64, 31, 3, 4096, 200_000


def fingerprint(text: str, seed: int = 42, shingle: int = 3, block: int = 1 << 17) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; without words zero.

    A-Z are lower-cased and words are runs of anything but ASCII white space.  A bit is set where
    over half the shingles' XXH64 values have it.  Fewer words than a shingle make one shingle.
    """
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    whole, digest = b" ".join(words), xxhash.xxh64_intdigest
    last = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: last - 1] + 1).tolist()]
    stops = ends[-last:].tolist()
    hashes = np.array([digest(whole[a:b], seed) for a, b in zip(starts, stops)], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), block):
        ones += np.unpackbits(hashes[at:at + block].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, seed: int = 42, shingle: int = 3) -> DataFrame:
    """(doc_id, same, fp) for every row of docs(doc_id, text); fp holds the 64 bits as a signed long,
    same is a hash of the text."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.only("simhash", dict)
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), seed, shingle) for t in batch.column(2)), dtype=np.uint64, count=batch.num_rows)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "same", "fp"])

    text = common.text_of("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("same"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, same long, fp long")


def _masks() -> list[list[int]]:
    """By syndrome: the error words of weight two or less that lead to a codeword.

    The anchors are the codewords of the perfect Hamming code on 31 bits: every word is within
    covering radius one of exactly one of them.  Bit j-1 contributes j to the syndrome.
    """
    words: list[list[int]] = [[] for _ in range(32)]
    words[0].append(0)
    for i in range(1, 32):
        words[i].append(1 << (i - 1))
        for j in range(i + 1, 32):
            words[i ^ j].append((1 << (i - 1)) | (1 << (j - 1)))
    return words


def _syndrome(half: Column) -> Column:
    total = F.lit(0)
    for k in range(5):
        mask = sum(1 << (j - 1) for j in range(1, 32) if j >> k & 1)
        total = total + F.shiftleft((F.bit_count(half.bitwiseAND(F.lit(mask))) % 2).cast("int"), k)
    return total


def _anchors(fps: DataFrame, near: bool) -> DataFrame:
    """(anchor, fp): for both 31-bit halves the anchor within radius one, or all within radius two."""
    words = _masks()
    if not near:
        words = [w[:1] if s == 0 else [1 << (s - 1)] for s, w in enumerate(words)]
    table = F.array(*[F.array(*[F.lit(x).cast("long") for x in w]) for w in words])
    mask = F.lit((1 << HALF) - 1).cast("long")
    halves = F.explode(F.array(
        F.struct(F.lit(0).cast("long").alias("side"), F.col("fp").bitwiseAND(mask).alias("half")),
        F.struct(F.lit(1 << 40).cast("long").alias("side"), F.shiftrightunsigned("fp", HALF + 1).bitwiseAND(mask).alias("half")),
    )).alias("h")
    rows = fps.select("fp", halves).select("fp", "h.side", "h.half")
    rows = rows.select("fp", "side", "half", F.explode(F.element_at(table, _syndrome(F.col("half")) + 1)).alias("error"))
    return rows.select((F.col("side") + F.col("half").bitwiseXOR(F.col("error"))).alias("anchor"), "fp")


def links(fps: DataFrame) -> DataFrame:
    """Links (u, v), u < v, between distinct fingerprints (column fp) that differ in 1 to 3 bits.

    Of two words that differ in three bits or fewer, one of two 31-bit halves differs in one bit at
    most.  So in each half a fingerprint stands at the anchor within covering radius 1, is copied to
    every anchor within radius 1 + 1, and the two are compared anchor by anchor in full: no link is
    missed.  A fingerprint has 32 copies at most and 43,744 partners at most, whatever the corpus.  An
    anchor where over BLOCK fingerprints stand, or over one in CROWDS of all, is dealt over blocks of
    them, and the copies to each; so the crowded anchors are CROWDS at most.
    """
    home = _anchors(fps, near=False)
    near = _anchors(fps, near=True).withColumnRenamed("fp", "other")
    crowded = max(BLOCK, -(-2 * fps.count() // CROWDS))
    crowds = home.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > crowded)
    crowds = F.broadcast(crowds.select("anchor", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))  # CROWDS rows at most
    one = F.coalesce("blocks", F.lit(1))
    home = home.join(crowds, "anchor", "left").select("anchor", "fp", F.pmod(F.xxhash64("fp"), one).cast("int").alias("block"))
    near = near.join(crowds, "anchor", "left").select("anchor", "other", F.explode(F.sequence(F.lit(0), one - 1)).alias("block"))
    # Copies of anchors are many times what a plan's estimate says: never broadcast them.
    pairs = home.join(near.hint("merge"), ["anchor", "block"]).where(
        (F.col("fp") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= THRESHOLD)
    )
    return pairs.select(F.least("fp", "other").alias("u"), F.greatest("fp", "other").alias("v")).distinct()


def groups(docs: DataFrame, seed: int = 42, shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs(doc_id, text).

    Equal fingerprints are one node, so copies are never paired; component_id is the smallest doc_id
    that links of three bits or fewer reach.  Null and empty texts, and texts of white space alone,
    have fingerprint zero and link like any other.  Repeated rows are rows each.  A null doc_id has
    a row and a component; as a component's name it counts only where there is no other.  An empty
    table gives no rows.  Very long texts are read whole, 131,072 shingles at a time.  Other columns,
    those named fingerprint or component_id too, are ignored.
    """
    return _grouped(docs, seed, shingle).drop("same")


def _grouped(docs: DataFrame, seed: int, shingle: int) -> DataFrame:
    prints = common.kept(fingerprints(docs, seed, shingle), "simhash")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    nodes = common.kept(nodes, "simhash-nodes")
    joined = common.components(links(nodes.select("fp")))
    roots = nodes.join(joined, nodes.fp == joined.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    names = roots.groupBy("component").agg(F.min("low").alias("component_id"))
    named = roots.join(names, "component").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(named, "fp").select("doc_id", "same", hexed, "component_id")


def deduplicate(docs: DataFrame, seed: int = 42, shingle: int = 3) -> DataFrame:
    """docs with one document of each group: the one with the smallest doc_id.  Rows equal in doc_id and
    text stay together; of a group without any doc_id all rows stay, of any other none without one."""
    keep = _grouped(docs, seed, shingle).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept"), F.col("same").alias("_same")).distinct()
    # A merge join: the kept ids grow with the corpus and are never broadcast.
    match = docs["doc_id"].cast("long").eqNullSafe(keep["_kept"]) & (F.xxhash64(common.text_of(docs["text"])) == keep["_same"])
    return docs.join(keep.hint("merge"), match, "left_semi")
