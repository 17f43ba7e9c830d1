"""Embedding near-duplicates by collision counting over one-dimensional projections."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm import common

CELL, BLOCK = 256, 4096
COUNTED, BATCH = 40, 1 << 19  # projections that travel; pairs counted at once
FOUND = "vec_id long, links long, root long"


def tables_for(n: int, threshold: float, missed: float) -> tuple[int, int]:
    """(signs a key, keys): keys so selective that a cell of n vectors without copies holds about CELL,
    and so many that a pair at the threshold shares none with probability `missed` at most."""
    signs = max(1, math.ceil(math.log2(max(2, n) / CELL)))
    same = (1 - math.acos(threshold) / math.pi) ** signs
    return signs, max(1, math.ceil(math.log(missed) / math.log1p(-same)))


def directions(dim: int, signs: int, keys: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim, signs, keys]).standard_normal((dim, signs * keys))


def rotation(dim: int, seed: int) -> np.ndarray:
    """Orthonormal directions, on which collisions are counted."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def window_and_count(dim: int, threshold: float, miss: float = 1e-6) -> tuple[float, int]:
    """Half width of the windows, and how many of dim projections must collide at least.

    Unit vectors with that cosine are r = sqrt(2 - 2 * threshold) apart; along a random direction
    that is about normal with deviation r / sqrt(dim).  At 2.5 deviations one projection collides
    with probability 0.9876; the count is the largest that a pair at the threshold reaches with
    probability 1 - miss.  Independently of chance no more than r^2 / width^2 projections can fail,
    so the count never asks for more than a smaller number of failures than that allows.
    """
    r = math.sqrt(max(0.0, 2 - 2 * threshold))
    width = 2.5 * r / math.sqrt(dim) + 1e-9
    p, fail, tail = 0.9876, 0, 1.0
    while fail < dim:
        tail -= math.comb(dim, fail) * (1 - p) ** fail * p ** (dim - fail)
        if tail <= miss:
            break
        fail += 1
    return width, dim - min(fail, math.ceil(r * r / (width * width)), dim)


def small(turned: np.ndarray, dim: int, width: float) -> tuple[np.ndarray, int]:
    """The first COUNTED projections in one byte each, and the half width in their units.

    Values past four deviations are clipped, which brings no two further apart; rounding moves two
    values one unit apart at most, and the half width has that unit.  The scale leaves room for a half
    width over the largest value, so that differences modulo 256 name each window exactly.
    """
    far = min(1.0, 4 / math.sqrt(dim))
    scale = 253 / (2 * far + width)
    own = np.rint((np.clip(turned[:, :COUNTED], -far, far) + far) * scale).astype(np.uint8)
    return own, min(127, int(width * scale + 1))


def _walk(a: np.ndarray, b: np.ndarray, half: int, wide: int, most_failed: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of pairs that collide in all but most_failed projections, some at a time; where
    same, i stands before j in the order of the first projection.

    Rows are sorted along the first projection and walked: a query meets the rows of its window, `wide`
    units to either side, as one stretch.  There the collisions of the other projections are counted,
    each in the window centred on the query's value.
    """
    one, two = np.argsort(a[:, 0], kind="stable"), np.argsort(b[:, 0], kind="stable")
    x, y = a[one], np.ascontiguousarray(b[two].T)
    at0, to0 = x[:, 0].astype(np.int32), y[0].astype(np.int32)
    low, high = np.searchsorted(to0, at0 - wide, "left"), np.searchsorted(to0, at0 + wide, "right")
    begin = (x - np.uint8(half)).astype(np.uint8)  # modulo 256
    at = 0
    while at < len(x):
        first = max(at, low[at]) if same else low[at]
        end = at + 1
        while end < len(x) and (end + 1 - at) * (high[end] - first) <= BATCH:
            end = min(len(x), end + max(1, (end - at) // 2))
        stretch = slice(int(first), int(high[end - 1]))
        hits = np.zeros((end - at, stretch.stop - stretch.start), np.uint8)
        gap, hit = np.empty_like(hits), np.empty(hits.shape, bool)
        for k in range(x.shape[1]):
            np.subtract(y[k][None, stretch], begin[at:end, k][:, None], out=gap)
            np.less_equal(gap, np.uint8(2 * half), out=hit)
            np.add(hits, hit.view(np.uint8), out=hits)
        i, j = np.divmod(np.flatnonzero(hits >= max(0, x.shape[1] - most_failed)), max(1, hits.shape[1]))
        i, j = i + at, j + stretch.start
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            yield one[i], two[j]
        at = end


def _wide(dim: int, threshold: float, width: float) -> int:
    """Half width of the walked windows: 4.5 deviations, so that 7 pairs in a million at the threshold
    lie outside."""
    return int(1.8 * width * 253 / (2 * min(1.0, 4 / math.sqrt(dim)) + width) + 1)


def _flags(a: np.ndarray, b: np.ndarray, dim: int, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of two sets of small() projections have a pair that reaches the count."""
    width, least = window_and_count(dim, threshold)
    half = small(np.zeros((0, dim)), dim, width)[1]
    x, y = np.zeros(len(a), bool), np.zeros(len(b), bool)
    for i, j in _walk(a, b, half, _wide(dim, threshold, width), dim - least, same):
        x[i] = True
        y[j] = True
    return x, y


def _pairs(a: np.ndarray, b: np.ndarray, dim: int, threshold: float, seed: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of pairs with cosine >= threshold, i in a, j in b; each once where same.

    Pairs that collide often enough in the small projections are counted over all of them in full; a
    pair that reaches the recall-calibrated count is verified by its cosine in double precision.
    """
    width, least = window_and_count(dim, threshold)
    turn = rotation(dim, seed)
    one, two = a @ turn, b @ turn
    p, half = small(one, dim, width)
    q = p if same else small(two, dim, width)[0]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i, j in _walk(p, q, half, _wide(dim, threshold, width), dim - least, same):
        for part in range(0, len(i), 1 << 16):  # rows are gathered for so many pairs at a time
            x, y = i[part:part + (1 << 16)], j[part:part + (1 << 16)]
            reach = (np.abs(one[x] - two[y]) <= width).sum(axis=1) >= least
            x, y = x[reach], y[reach]
            exact = np.einsum("ij,ij->i", a[x], b[y]) >= threshold
            found.append((x[exact], y[exact]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest position that links reach, by position."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        if (root == before).all() and (root[i] == root[j]).all():
            break
    return root


def _unit(data: bytes, dim: int) -> np.ndarray:
    x = np.frombuffer(data, "<f8" if len(data) == 8 * dim else "<f4").astype(float)
    x = x / np.abs(x).max()  # first, lest squares overflow
    return x / np.linalg.norm(x)


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, key, dim, data): equal vectors have equal bytes, in single precision where that holds
    them whole, and equal keys, half a SHA-256 of them.  Vectors that link with nothing have no key."""
    for batch in batches:
        keys, dims, data = [], [], []
        for x in batch.column(1):
            values = None if not x.is_valid or x.values.null_count or not len(x.values) else np.asarray(x.values.to_numpy(zero_copy_only=False), "<f8")
            if values is None or not np.isfinite(values).all() or not values.any():
                keys.append(None), dims.append(None), data.append(None)
                continue
            values = values + 0.0  # -0.0 and 0.0 are one
            with np.errstate(over="ignore"):
                short = values.astype("<f4")
            raw = (short if (short == values).all() else values).tobytes()
            keys.append(hashlib.sha256(b"%d:" % len(values) + raw).digest()[:16]), dims.append(len(values)), data.append(raw)
        yield pa.record_batch([batch.column(0), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(data, pa.binary())], names=["vec_id", "key", "dim", "data"])


def links(vectors: DataFrame, threshold: float = 0.95, missed: float = 1e-4, seed: int = 11) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding).

    Equal vectors are one node with a multiplicity.  One projection's window holds a constant share
    of all pairs (two fifths here), so counting over whole sorted projections would be quadratic.
    Projections are therefore first taken together: a key is the signs of some of them, and vectors
    meet by key, in as many tables as the recall asks for (`missed`, for a pair at the threshold;
    closer pairs are missed far less).  Within a cell, a sorted projection is walked and query-centred
    window collisions counted by pair.  What travels to the cells is COUNTED projections in a byte each;
    only vectors with a pair that reaches the recall-calibrated count are then sent whole, and their
    pairs, counted again in full, verified by their cosine in double precision.  A pair counts in the
    first table where it meets.

    A cell over BLOCK vectors is dealt over pairs of blocks, so a group that holds a third of all rows
    is compared by many tasks, and what leaves a task is a row or two a vector: the number of its
    links and the smallest vector it reaches.  Links are never all written out.

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing: 0
    links, a component of their own.  Vectors of other lengths never link.  Rows without vec_id are
    compared, but name no component unless alone.  Repeated rows are rows each, linked to each other
    as equal vectors are.  An empty table gives no rows.  Very long vectors are compared whole.  Other
    columns, those named like a result's too, are ignored.
    """
    spark = vectors.sparkSession
    common.ship(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = common.kept(rows.mapInArrow(_plain, "vec_id long, key binary, dim int, data binary"), "vectors")
    nodes = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("data").alias("data"))
    n = max(1, rows.agg(F.count("key")).first()[0])
    signs, keys = tables_for(n, threshold, missed)
    weights = 1 << np.arange(signs, dtype=np.int64)

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(4).to_numpy()
            units = [_unit(d.as_py(), n) for d, n in zip(batch.column(5), dims.tolist())]
            own, sent = np.zeros((len(units), keys), np.int64), [b""] * len(units)
            for dim in set(dims.tolist()):
                some = np.flatnonzero(dims == dim)
                x = np.array([units[k] for k in some])
                own[some] = (x @ directions(dim, signs, keys, seed) >= 0).reshape(len(some), keys, signs) @ weights
                for k, row in zip(some, small(x @ rotation(dim, seed), dim, window_and_count(dim, threshold)[0])[0]):
                    sent[k] = row.tobytes()
            packed = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(units) + 1) * keys, keys, dtype=np.int32)), pa.array(own.astype(np.int32).ravel()))
            yield pa.record_batch([*batch.columns, packed, pa.array(sent, pa.binary())], names=["node", "key", "low", "copies", "dim", "data", "signature", "small"])

    schema = "node long, key binary, low long, copies long, dim int, data binary, signature array<int>, small binary"
    nodes = nodes.select(F.monotonically_increasing_id().alias("node"), "key", "low", "copies", "dim", "data")
    nodes = common.kept(nodes.mapInArrow(signatures, schema), "nodes")
    met = nodes.select("node", "dim", "small", F.posexplode("signature").alias("k", "cell"))
    sizes = nodes.select("dim", F.posexplode("signature").alias("k", "cell")).groupBy("dim", "k", "cell").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK)
    sizes = sizes.select("dim", "k", "cell", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    met = met.join(sizes, ["dim", "k", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    met = met.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = met.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("first", F.least("own", "with")).withColumn("second", F.greatest("own", "with")).drop("blocks", "with")
    meet = ["dim", "k", "cell", "first", "second"]

    def flag(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        own, dim = table.column("own").to_numpy(), table.column("dim")[0].as_py()
        p = np.frombuffer(b"".join(table.column("small").to_pylist()), np.uint8).reshape(table.num_rows, -1)
        found = np.zeros(table.num_rows, bool)
        if table.column("first")[0] == table.column("second")[0]:
            x, y = _flags(p, p, dim, threshold, True)
            found = x | y
        else:
            a, b = np.flatnonzero(own == table.column("first")[0].as_py()), np.flatnonzero(own == table.column("second")[0].as_py())
            found[a], found[b] = _flags(p[a], p[b], dim, threshold, False)
        return table.select(["node", "own", *meet]).filter(pa.array(found))

    def verify(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        get = lambda name: table.column(name).to_numpy()
        dim, k, node, copies, own = int(get("dim")[0]), int(get("k")[0]), get("node"), get("copies"), get("own")
        x = np.array([_unit(d, dim) for d in table.column("data").to_pylist()])
        sign = table.column("signature").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(node), -1)
        if get("first")[0] == get("second")[0]:
            i, j = _pairs(x, x, dim, threshold, seed, True)
        else:
            a, b = np.flatnonzero(own == get("first")[0]), np.flatnonzero(own == get("second")[0])
            i, j = _pairs(x[a], x[b], dim, threshold, seed, False)
            i, j = a[i], b[j]
        fresh = np.ones(len(i), bool)
        for at in range(0, len(i) if k else 0, 1 << 16):
            s = slice(at, at + (1 << 16))
            fresh[s] = ~(sign[i[s], :k] == sign[j[s], :k]).any(axis=1)
        i, j = i[fresh], j[fresh]
        count = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
        root = node[_roots(len(node), i, j)]
        some = count > 0
        return pa.table({"vec_id": node[some], "links": count[some].astype(np.int64), "root": root[some]}).cast(pa.schema([("vec_id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())]))

    flagged = met.groupBy(*meet).applyInArrow(flag, "node long, own int, dim int, k int, cell int, first int, second int")
    flagged, flagged_uri = common.keep(flagged, "flagged")
    whole = flagged.join(nodes.select("node", "copies", "signature", "data"), "node")
    found = common.kept(whole.groupBy(*meet).applyInArrow(verify, FOUND), "links")
    common.remove(spark, flagged_uri)
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("links")).withColumnRenamed("vec_id", "node")
    edges = found.where("vec_id <> root").select(F.col("vec_id").alias("u"), F.col("root").alias("v"))
    joined = common.components(edges)
    # Each node's component is named by the smallest vec_id in it.
    named = nodes.select("node", "key", "low", "copies").join(joined, "node", "left").join(counts, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("low").alias("component_id"))
    per_node = named.join(names, "component").select("key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("vec_id", "key").join(per_node, "key", "left")
    own = F.coalesce("component_id", "vec_id").alias("component_id")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
