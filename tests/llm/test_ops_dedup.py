"""Embedding and SimHash near-duplicates against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoframe.llm import common, embeddings, simhash


def components_by_force(n, pairs):
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


def vectors(seed=0, n=900, dim=16):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim))
    x[100:160] = x[100] + 0.12 * r.standard_normal((60, dim))
    x[200:205] = x[200]
    for k in range(300, 320):  # a chain: neighbours link, ends don't
        x[k] = x[k - 1] / np.linalg.norm(x[k - 1]) + 0.06 * r.standard_normal(dim)
    return x


def test_links_equal_brute_force(spark):
    x = vectors().astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist(), 3) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embeddings.links(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    pairs = [(i, j) for i in range(len(x)) for j in range(i) if s[i, j] >= 0.95]
    assert len(pairs) > 1000 and not ((s > 0.95 - 1e-7) & (s < 0.95 + 1e-7)).any()
    root = components_by_force(len(x), pairs)
    n = np.bincount(np.array(pairs).ravel(), minlength=len(x))
    assert [got[k].n_links for k in range(len(x))] == n.tolist()
    assert [got[k].component_id for k in range(len(x))] == root
    assert all(got[k].kept == (root[k] == k) for k in range(len(x)))


def test_large_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 32)
    r = np.random.default_rng(1)
    x = np.concatenate([r.standard_normal((60, 8)), r.standard_normal(8) + 0.02 * r.standard_normal((200, 8))])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.links(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T >= 0.95
    assert [got[k][0] for k in range(len(x))] == (s.sum(1) - 1).tolist() and len({got[k][1] for k in range(60, 260)}) == 1


def test_recall_at_a_hundred_thousand(spark, tmp_path):
    """Pairs just over the threshold planted among 10^5 vectors, of which chance brings none so near."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    r = np.random.default_rng(8)
    x = r.standard_normal((100_000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a = x[:30_000]
    b = x[30_000:60_000] - (a * x[30_000:60_000]).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    x[30_000:60_000] = 0.9501 * a + np.sqrt(1 - 0.9501**2) * b
    column = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, 48, dtype=np.int32)), pa.array(x.ravel()))
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": column}), tmp_path / "e.parquet")
    got = embeddings.links(spark.read.parquet(str(tmp_path / "e.parquet"))).groupBy("n_links").count().collect()
    n = {g.n_links: g["count"] for g in got}
    assert set(n) <= {0, 1} and n[1] >= 2 * 30_000 * 0.9995


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [2.0, 0.0]), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (11, [-0.0, 0.0]), (12, [1e300, 0.0]), (13, [1.0, -0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n_links", F.lit("x"))
    got = sorted(((r.vec_id or 0), r.n_links, r.component_id, r.kept) for r in embeddings.links(df).collect())
    linked = [(0, 6, 1, False), (1, 6, 1, True), (2, 6, 1, False), (2, 6, 1, False), (9, 6, 1, False), (12, 6, 1, False), (13, 6, 1, False)]
    alone = [(k, 0, k, True) for k in (3, 4, 5, 6, 7, 8, 10, 11)]
    assert got == sorted(linked + alone)
    assert embeddings.links(df.limit(0)).count() == 0


def test_counts_keep_pairs_at_the_threshold():
    r = np.random.default_rng(5)
    for dim in (2, 8, 64):
        a = r.standard_normal((3000, dim))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b = r.standard_normal((3000, dim))
        b -= (a * b).sum(1, keepdims=True) * a
        b /= np.linalg.norm(b, axis=1, keepdims=True)
        b = 0.9500001 * a + np.sqrt(1 - 0.9500001**2) * b
        kept = sum(len(embeddings._pairs(a[k:k + 1], b[k:k + 1], dim, 0.95, 11, False)[0]) for k in range(3000))
        assert kept == 3000


def test_tables_reach_the_recall():
    for n in (10, 10_000, 10**9):
        signs, keys = embeddings.tables_for(n, 0.95, 1e-4)
        assert (1 - (1 - np.arccos(0.95) / np.pi) ** signs) ** keys <= 1e-4


def test_components_of_chains_stars_and_nothing(spark):
    pairs = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (200, 201)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert {got[k] for k in range(51)} == {0} and {got[k] for k in range(100, 160)} == {100} and got[201] == 200 and len(got) == 51 + 60 + 2
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def fingerprint_by_force(text):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    grams = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


TEXTS = ["", " \t\n", "One", "one TWO", "a b c", "a b c d e f g", "É é x  ß\x0bz", "日本 語 テ ス ト", "x " * 5000, "a b c a b c a b c"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == fingerprint_by_force(text) == simhash.fingerprint(text, block=3)


def test_every_near_pair_shares_an_anchor(spark):
    r = np.random.default_rng(2)
    base = r.integers(0, 2**63, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for f in base.tolist():
        for _ in range(25):
            for b in r.choice(64, r.integers(1, 6), replace=False):
                f ^= 1 << int(b)
            fps.add(f)
    fps = sorted(fps)
    signed = lambda f: f - (1 << 64) if f >= 1 << 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {(r.u, r.v) for r in simhash.links(df).collect()}
    want = {tuple(sorted((signed(a), signed(b)))) for k, a in enumerate(fps) for b in fps[:k] if bin(a ^ b).count("1") <= 3}
    assert got == want and len(want) > 50


def test_crowded_anchors_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 4)
    r = np.random.default_rng(4)
    centre = int(r.integers(0, 2**62))
    fps = sorted({centre} | {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in r.integers(0, 62, (150, 2))})
    got = {(x.u, x.v) for x in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    want = {(a, b) for k, b in enumerate(fps) for a in fps[:k] if bin(a ^ b).count("1") <= 3}
    assert got == want and len(want) > 300


def test_groups_equal_brute_force(spark):
    r = np.random.default_rng(3)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(r.choice(words, 200)) for _ in range(60)]
    for k in range(40):
        w = texts[k % 7].split()
        w[int(r.integers(200))] = "changed"
        texts.append(" ".join(w))
    texts += ["", "  ", None, texts[3], "one two"]
    df = spark.createDataFrame([(k + 10, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, component_id string")
    got = {x.doc_id: x for x in simhash.groups(df).collect()}
    fps = [fingerprint_by_force(t or "") for t in texts]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3]
    root = components_by_force(len(fps), pairs)
    assert [got[k + 10].fingerprint for k in range(len(fps))] == [f"{f:016x}" for f in fps]
    assert [got[k + 10].component_id - 10 for k in range(len(fps))] == root and len(set(root)) < len(root) - 15
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns and sorted(x.doc_id - 10 for x in kept.collect()) == sorted(set(root))


def test_groups_edges(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "only here")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.groups(df).collect())
    assert got == [(0, 0), (0, 1), (1, 1), (1, 1)]
    kept = sorted(((r.doc_id or 0), r.text) for r in simhash.deduplicate(df).collect())
    assert kept == [(0, "only here"), (1, "a b c"), (1, "a b c")]
    assert simhash.groups(df.limit(0)).count() == 0
