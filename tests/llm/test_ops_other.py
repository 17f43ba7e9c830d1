"""Quality, mixing, sharding, media, WARC, pipeline, and how the subpackage stands apart."""

import base64
import hashlib
import os
import re
import struct
import subprocess
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoframe.llm import common, media, mixing, quality, queries, sharding, warc

FOLDER = "/root/testdata/sf0.001"


def corpus(n=400, seed=0):
    r = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in ("the", "an", "or", "in", "ing", "er") for b in ("re", "th", "on", "at", "es", "ed")]
    rows = []
    for k in range(n):
        w = r.choice(words, int(r.integers(20, 120))).tolist()
        bad = k % 3 == 0
        if bad:
            w = [x.upper() + "!!" for x in w] if k % 2 else [x for x in w[:10] for _ in range(8)]
        rows.append((k, " ".join(w), "en", "s", 0, 0 if bad else 1))
    return rows


def test_quality_on_held_out_rows(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:5] for r in rows] + [(9001, None, "en", "s", 0), (9002, "", None, None, None), (None, "the re", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    vectors, net = quality.fit(docs, labels)
    got = quality.score(docs, vectors, net).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    truth = {r[0]: r[5] for r in rows}
    held = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in held]) > 0.95
    flipped = spark.createDataFrame([(r[0], 1 - r[5] if zlib.crc32(str(r[0]).encode()) % 3 == 1 else r[5]) for r in rows], "doc_id long, quality int")
    other = quality.fit(docs, flipped)[1]
    assert np.array_equal(net.a, other.a) and net.temperature == other.temperature
    kept = quality.keep_good(docs, labels)
    good = {r.doc_id for r in got if r.predicted}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == good


def test_quality_without_rows_or_classes(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.score(docs, *quality.fit(docs, none)).collect()] == [0.5]
    ones = spark.createDataFrame([(1, 1), (2, 1), (4, 1)], "doc_id long, quality int")
    assert quality.score(docs, *quality.fit(docs, ones)).first().score > 0.9
    assert quality.score(docs.limit(0), *quality.fit(docs.limit(0), none)).count() == 0


def test_contexts_equal_brute_force(spark):
    texts = ["the cat THE", "a b a b", None, "x"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    places, signs = quality.index_vectors()
    want = np.zeros((quality.WORDS, quality.SIZE))
    for t in texts:
        ids = np.frombuffer(quality.Words().of(t or ""), "<i4")
        for i in range(len(ids)):
            for j in range(max(0, i - 2), min(len(ids), i + 3)):
                if i != j:
                    np.add.at(want[ids[i]], places[ids[j]], signs[ids[j]])
    assert np.array_equal(quality.contexts(docs), want)


def test_temperature_lowers_the_loss():
    r = np.random.default_rng(0)
    x = r.standard_normal((300, 40))
    y = (r.random(300) < 1 / (1 + np.exp(-x[:, 0]))).astype(int)
    net = quality.train(x, y, epochs=60)
    held = np.random.default_rng(7).permutation(300)[:60]  # what train() keeps for the temperature

    def loss(t):
        z = net.logits(x[held]) / t
        return np.mean(np.logaddexp(0, z) - y[held] * z)

    best = min(loss(t) for t in np.exp(np.linspace(-3, 3, 601)))
    assert net.temperature > 1.5 and loss(net.temperature) < loss(1.0) - 0.1 and loss(net.temperature) < best + 1e-4


def test_scores_equal_brute_force(spark):
    rows = corpus(90) + [(500, "Word " * 30_000, "en", "s", 0, 1), (501, "", "en", "s", 0, 1)]
    docs = spark.createDataFrame([(r[0], r[1], 0.5) for r in rows], "doc_id long, text string, score double")
    vectors, net = quality.fit(docs, spark.createDataFrame([(r[0], r[5]) for r in rows], "doc_id long, quality int"))
    got = {r.doc_id: r.score for r in quality.score(docs, vectors, net).collect()}
    for doc, text, *_ in rows:
        ids = np.frombuffer(quality.Words().of(text), "<i4").tolist()
        n = max(1, len(ids))
        again = sum(1 for k, w in enumerate(ids) if w >= quality.FIRST and w in ids[max(0, k - 2):k])
        x = np.array([*(sum(vectors[w].astype(float) for w in ids) / n if ids else np.zeros(vectors.shape[1])), again / n, np.log1p(len(ids)) / 10])
        hidden = np.tanh((x - net.shift) / net.scale @ net.a + net.b)
        assert got[doc] == pytest.approx(1 / (1 + np.exp(-(hidden @ net.c + net.d) / net.temperature)), abs=1e-4)


def test_labels_are_bounded_and_count_once(spark):
    rows = corpus(200)
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows for _ in range(3)], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows for _ in range(2)], "doc_id long, quality int")
    once = quality.fit(docs.distinct(), labels.distinct(), sample_rows=40)[1]
    thrice = quality.fit(docs, labels.repartition(7), sample_rows=40)[1]
    assert np.array_equal(once.shift, quality.fit(docs.distinct().repartition(5), labels, sample_rows=40)[1].shift)
    assert np.allclose(once.shift[-2:], thrice.shift[-2:])  # the same documents, whatever repeats


def pour_by_hand(capacity, weight, budget):
    """Fill step by step: full children leave, the others share what is left by weight."""
    level, left, open_ = {}, budget, set(capacity)
    while open_:
        h = left / sum(weight[k] for k in open_)
        full = {k for k in open_ if capacity[k] <= h * weight[k]}
        if not full:
            level |= {k: int(h * weight[k]) for k in open_}
            break
        level |= {k: capacity[k] for k in full}
        left -= sum(capacity[k] for k in full)
        open_ -= full
    return level


def test_budgets_go_to_siblings_before_ancestors(spark):
    tokens = {("web", "en", "a"): 1000, ("web", "en", "b"): 10, ("web", "fr", "c"): 40, ("reference", "en", "d"): 100}
    mixture = mixing.Mixture(domain={"web": 3, "reference": 2}, lang={"en": 3}, max_epochs=2, budget_percent=50)
    units = spark.createDataFrame([(k, *p, n) for k, (p, n) in enumerate(tokens.items())], "doc_id long, domain string, lang string, source string, n_tokens long")
    got = {(r.domain, r.lang, r.source): r.leaf_budget for r in mixing.budgets(units, mixture).collect()}
    top = pour_by_hand({"web": 2100, "reference": 200}, {"web": 3, "reference": 2}, 575)
    web = pour_by_hand({"en": 2020, "fr": 80}, {"en": 3, "fr": 1}, top["web"])
    en = pour_by_hand({"a": 2000, "b": 20}, {"a": 1, "b": 1}, web["en"])
    assert top["reference"] == 200 and got == {("web", "en", "a"): en["a"], ("web", "en", "b"): 20, ("web", "fr", "c"): web["fr"], ("reference", "en", "d"): 200}


def test_epochs_are_whole_then_a_seeded_prefix(spark):
    rows = [(k, "w " * (k % 7 + 1), "en", "s") for k in range(300)] + [(1000 + k, "w w", "en", "t") for k in range(5)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, source string, epoch int")
    mixture = mixing.Mixture(max_epochs=3, budget_percent=60, domain={"all": 1}, lang={})
    got = mixing.choose(docs, mixture, F.lit("all")).collect()
    budget = {r.source: (r.leaf_tokens, r.leaf_budget) for r in got}
    for s, (total, want) in budget.items():
        assert want <= sum(r.n_tokens for r in got if r.source == s) < want + 7 and want <= 3 * total
    n = {s: total for s, (total, _) in budget.items()}
    key = lambda d, e: hashlib.md5(f"17:{e}:{d}".encode()).hexdigest()
    whole, rest = divmod(budget["s"][1], n["s"])
    order = sorted((r[0] for r in rows if r[3] == "s"), key=lambda d: key(d, whole))
    taken, at = set(), 0
    for d in order:
        if at < rest:
            taken.add(d)
        at += d % 7 + 1
    assert {r.doc_id for r in got if r.source == "s" and r.epoch == whole} == taken
    again = mixing.mix(docs, mixture, F.lit("all"))
    assert again.columns == docs.columns and sorted(r.doc_id for r in again.collect()) == sorted(r.doc_id for r in got)


def test_mixing_edges(spark):
    df = spark.createDataFrame([(1, None, None, None), (1, "a b", "en", "s"), (1, "a b", "en", "s"), (None, "c", "en", "s")], "doc_id long, text string, lang string, source string")
    assert mixing.choose(df).count() > 0 and mixing.mix(df).columns == df.columns
    assert mixing.choose(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0
    clash = spark.createDataFrame([(1, "w " * 200_000, "en", "s", "mine", 7), (2, "a b", "en", "s", "mine", 8)], "doc_id long, text string, lang string, source string, domain string, n_tokens int")
    whole = mixing.Mixture(max_epochs=1, budget_percent=100)
    assert {(r.doc_id, r.n_tokens, r.epoch) for r in mixing.choose(clash, whole).collect()} == {(1, 200_000, 0), (2, 2, 0)}
    kept = mixing.mix(clash, whole)
    assert kept.columns == clash.columns and sorted((r.doc_id, r.domain, r.n_tokens) for r in kept.collect()) == [(1, "mine", 7), (2, "mine", 8)]


def test_placement_by_a_column_that_is_replaced(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("b" * 100_000, 3)], "shard string, x int")
    got = {r.x: (r.slot, r.shard) for r in sharding.place(df, "shard", ["p", "q"]).collect()}
    table = sharding.lookup_table(["p", "q"])
    for x, key in ((1, "a"), (2, ""), (3, "b" * 100_000)):
        slot = int(hashlib.md5(key.encode()).hexdigest()[:8], 16) % sharding.PRIME
        assert got[x] == (slot, ["p", "q"][table[slot]])


def test_warc_sample_doesnt_depend_on_order(spark):
    rows = [(k % 40, f"http://h/{k % 40}", "<html>" + "text " * (k % 40) + "</html>") for k in range(200)]
    one = spark.createDataFrame(rows, "page_id long, url string, html string")
    paths = []
    for df in (one.coalesce(1), one.repartition(5)):
        paths.append(common.scratch(spark, "test-warc"))
        warc.write(df, paths[-1], sample_records=9)
    leads = {bytes(r.content[8:8 + struct.unpack_from("<I", r.content, 4)[0]]) for p in paths for r in spark.read.format("binaryFile").load(p).where("length > 0").collect()}
    assert len(leads) == 1 and all(warc.read(spark, p).count() == 200 for p in paths)


def test_lookup_table():
    names = [f"s{k}" for k in range(7)]
    table = sharding.lookup_table(names, 1009)
    sizes = np.bincount(table)
    assert min(table) == 0 and sizes.max() - sizes.min() <= 1
    order = {k: [(o + j * s) % 1009 for j in range(1009)] for k, (o, s) in enumerate(sharding._preference(n, 1009) for n in names)}
    want, nxt, k = [-1] * 1009, [0] * 7, 0
    while -1 in want:
        while want[order[k][nxt[k]]] >= 0:
            nxt[k] += 1
        want[order[k][nxt[k]]] = k
        k = (k + 1) % 7
    assert table == want
    assert sharding.move_share(names, names[:-1], 1009) < 0.35
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 1000)


def test_placement_is_native_and_total(spark, tmp_path):
    df = spark.range(500).selectExpr("id AS doc_id", "'x' AS slot").unionByName(spark.range(2).selectExpr("CASE WHEN id = 0 THEN 7 END AS doc_id", "'x' AS slot"))
    out = sharding.place(df, "doc_id", queries.SHARDS)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not re.search("Python|Arrow|Pandas|ExistingRDD|hashpartitioning", plan)
    table = sharding.lookup_table(queries.SHARDS)
    rows = out.collect()
    assert len(rows) == 502
    for r in rows:
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:8], 16) % sharding.PRIME
        assert (r.slot, r.shard) == (slot, queries.SHARDS[table[slot]])
    sharding.write_sharded(df, "doc_id", queries.SHARDS[:3], str(tmp_path / "s"), 2)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 502 and sharding.place(df.limit(0), "doc_id", ["a"]).count() == 0


def test_chunks_are_content_defined():
    r = np.random.default_rng(0)
    data = r.integers(0, 256, 300_000, dtype=np.uint8).tobytes()
    ends = media.cuts(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes[:-1].min() >= 2048 and sizes.max() <= 32_768
    gear, h, slow, start = media._gear().tolist(), 0, [], 0
    for k, b in enumerate(data):
        h = ((h << 1) + gear[b]) & 0xFFFFFFFF
        if (k + 1 - start >= 2048 and k >= 31 and h >> 19 == 0) or k + 1 - start == 32_768:
            slow.append(k + 1)
            start = k + 1
    assert ends == slow + ([len(data)] if start < len(data) else []) and media.cuts(data, block=5000) == ends
    moved = {hashlib.sha256(c).digest() for c in media.chunks_of(b"inserted" + data)}
    same = [c for c in media.chunks_of(data) if hashlib.sha256(c).digest() in moved]
    assert len(same) >= len(ends) - 2
    assert media.cuts(b"") == [0] and media.cuts(b"x" * 100) == [100] and max(np.diff([0, *media.cuts(b"\0" * 100_000)])) <= 32_768


def test_media_round_trip(spark):
    r = np.random.default_rng(1)
    long = " ".join(f"word{k}" for k in r.integers(0, 5000, 30_000))
    texts = {1: "short", 2: None, 3: "", 4: long, 5: "intro " + long, 6: "short", 7: "x" * 576, 8: "é" * 400}
    df = spark.createDataFrame([(k, t, "z") for k, t in texts.items()] + [(6, "short", "z"), (None, long, "z")], "doc_id long, text string, feature string").repartition(3)
    path = common.scratch(spark, "test-media")
    store = media.write(df, path)
    got = media.read(spark, store).collect()
    assert len(got) == 10
    for x in got:
        t = (long if x.doc_id is None else texts[x.doc_id]) or ""
        p = t.encode() + b"\xff" * (max(1, -(-len(t.encode()) // 576)) * 576 - len(t.encode()))
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(t.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    by = {x.doc_id: (x.media_bytes, x.media_sha256, x.feature) for x in got}
    assert by[1] == by[6] and by[2] == by[3] and by[4] == by[None]
    chunks = store.chunks(spark)
    assert chunks.count() == chunks.select("digest").distinct().count()
    assert sum(c.size for c in chunks.select("size").collect()) < 1.3 * len(long)
    empty = common.scratch(spark, "test-media")
    assert media.read(spark, media.write(df.limit(0), empty)).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("chunks_")]
    later = media.write(df, common.scratch(spark, "test-media"), earlier=store)
    assert later.chunks(spark).count() == 0 and later.lists(spark).count() == 10


def test_hot_chunks_are_sent_once_and_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(media, "SHARED", 3)
    r = np.random.default_rng(3)
    head = " ".join(f"w{k}" for k in r.integers(0, 9000, 9000))
    texts = [head + f" tail {k}" for k in range(20)] + ["same"] * 9 + [head]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    store = media.write(df, common.scratch(spark, "test-media"))
    chunks = store.chunks(spark).collect()
    assert len(chunks) == len({bytes(c.digest) for c in chunks}) == len({x for t in texts for x in media.chunks_of(media.payload_of(t))})
    got = {x.doc_id: x for x in media.read(spark, store).collect()}
    assert [got[k].payload_sha256 for k in range(len(texts))] == [hashlib.sha256(media.payload_of(t)).hexdigest() for t in texts]


def test_media_chunks_are_never_all_in_one_shuffle(spark):
    r = np.random.default_rng(5)
    texts = [" ".join(map(str, r.integers(0, 10**9, 4000))) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).cache()
    df.count()
    context, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def shuffled():
        context.listenerBus().waitUntilEmpty()
        stages = context.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in map(stages.apply, range(stages.size()))}

    before = shuffled()
    store = media.write(df, common.scratch(spark, "test-media"))
    most = max(n for k, n in shuffled().items() if k not in before)
    chunks = store.chunks(spark).withColumn("file", F.input_file_name()).collect()
    stored = sum(len(c.data) for c in chunks)
    assert 0.5 * stored < most < 0.8 * stored
    assert len(chunks) == len({bytes(c.digest) for c in chunks}) == len({x for t in texts for x in media.chunks_of(media.payload_of(t))})
    low, high = media.ranges_of(media.ROUNDS)
    sides = {}
    for c in chunks:
        sides.setdefault(c.file, set()).add(bytes(c.digest) < low[1])
    assert all(len(x) == 1 for x in sides.values()) and low[1] == high[0]
    assert {x.doc_id: x.payload_sha256 for x in media.read(spark, store).collect()} == {k: hashlib.sha256(media.payload_of(t)).hexdigest() for k, t in enumerate(texts)}
    df.unpersist()


def test_media_rounds_hold_every_digest_once(spark):
    edges = [b"\0" * 32, b"\xff" * 32]
    for n in (1, 2, 3):
        ranges = media.ranges_of(n)
        assert len(ranges) == n and ranges[0][0] == b"" and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
        around = [m + b"\0" * 28 for m, _ in ranges[1:]] + [(int.from_bytes(m, "big") - 1).to_bytes(4, "big") + b"\xff" * 28 for m, _ in ranges[1:]]
        at = edges + around
        assert all(sum(a <= d < b for a, b in ranges) == 1 for d in at)
        rows = spark.createDataFrame([(bytearray(d),) for d in at], "d binary")
        assert sum(rows.where((F.col("d") >= F.lit(a)) & (F.col("d") < F.lit(b))).count() for a, b in ranges) == len(at)
        ends = [int.from_bytes(b[:4], "big") / ((1 << 32) - 1) for _, b in ranges]
        shares = np.diff([0, *ends])
        assert max(shares * 2 + np.cumsum([0, *shares[:-1]])) == pytest.approx(2 / (2 - 2 ** (1 - n)))


def test_media_columns_equal_brute_force(spark):
    import math

    import zstandard

    texts = ["a b", "é" * 700, "", " ".join(str(k * k) for k in range(9000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in media.read(spark, media.write(df, common.scratch(spark, "test-media"))).collect():
        p = texts[x.doc_id].encode()
        p += b"\xff" * (max(1, -(-len(p) // 576)) * 576 - len(p))
        stored = b"".join(zstandard.ZstdCompressor(level=9).compress(p[a:b]) for a, b in zip([0, *media.cuts(p)[:-1]], media.cuts(p)))
        assert (x.media_bytes, x.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        shares = [p.count(bytes([b])) / len(p) for b in set(p)]
        want = {"mean": sum(p) / len(p), "rms": math.sqrt(sum(b * b for b in p) / len(p)), "entropy": -sum(s * math.log2(s) for s in shares), "samples": len(p)}
        assert {k: float(v) for k, v in (f.split("=") for f in x.feature.split(";"))} == pytest.approx(want, abs=2e-6)


def test_media_finds_damage(spark):
    import zstandard

    z = zstandard.ZstdCompressor().compress(b"b")
    m = media._Media(media.recipe_of([hashlib.sha256(b"a").digest()]))
    with pytest.raises(ValueError, match="digest"):
        m.add(hashlib.sha256(b"a").digest(), z, zstandard.ZstdDecompressor().decompress)
    m.add(hashlib.sha256(b"b").digest(), z, zstandard.ZstdDecompressor().decompress)
    with pytest.raises(ValueError, match="list"):
        m.row()


PAGES = [(3, "http://a/1", "<p>one</p>"), (1, "http://a/2", "<p>one</p>"), (2, "http://a b\r\nX: y", "é" * 50), (4, None, None), (5, "u", ""), (6, "u", "x" * 100_000), (7, "u", "a\r\n\r\nb"), (None, "u", "<p>one</p>"), (1, "http://a/2", "<p>one</p>"), (None, "n", "alone")]


def test_warc_round_trip(spark):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, payload string").repartition(2)
    path = common.scratch(spark, "test-warc")
    warc.write(df, path, file_bytes=2000)
    got = warc.read(spark, path).collect()
    assert len(got) == len(PAGES)
    first = {1: "<p>one</p>", 4: ""}
    for r in got:
        html = [h or "" for p, _, h in PAGES if p == r.page_id and (p is not None or base64.b32encode(hashlib.sha1(h.encode()).digest()).decode() == r.payload_digest)][0]
        assert r.payload_bytes == len(html.encode()) and r.payload_digest == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        kind = {3: 1, 5: 4}.get(r.page_id, 1 if r.page_id is None and html == first[1] else None)
        assert (r.record_type, r.refers_to) == (("revisit", kind) if kind else ("response", None))
        assert r.payload is None if kind else bytes(r.payload) == html.encode()


def test_warc_short_payloads_stay_responses(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = common.scratch(spark, "test-warc")
    warc.write(df, path, min_bytes=5)
    assert {r.page_id for r in warc.read(spark, path).where("record_type = 'revisit'").collect()} == {3, None}


def test_warc_file_layout(spark):
    import glob

    import zstandard

    r = np.random.default_rng(0)
    rows = [(k, f"http://h/{k}", "<html>" + " ".join(f"<p>line {x}</p>" for x in r.integers(0, 50, 60))) for k in range(300)]
    path = common.scratch(spark, "test-warc")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path, dictionary_bytes=4096)
    data = open(sorted(glob.glob("/" + path.removeprefix("file:").lstrip("/") + "/part-*"))[0], "rb").read()
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D and 0 < size <= 4096 and struct.unpack_from("<I", data, 8)[0] == 0xEC30A437
    own = zstandard.ZstdCompressionDict(data[8:8 + size])
    one = zstandard.ZstdDecompressor(dict_data=own).decompressobj()
    text = one.decompress(data[8 + size:])
    assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n") and one.unused_data[:4] == struct.pack("<I", 0xFD2FB528) and text.count(b"WARC/1.1") == 1


def test_warc_of_an_empty_table(spark):
    path = common.scratch(spark, "test-warc")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read(spark, path).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names, seen = docs.columns, docs
    for k, (_, stage) in enumerate(cp.STAGES):
        seen = stage(spark, seen, FOLDER)
        if k < len(cp.STAGES) - 1:
            assert seen.columns == names
            seen = common.kept(seen, "test-stage")
    assert sorted(map(tuple, seen.collect())) and cp.run(spark, FOLDER).count() == seen.count()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in cp.run(spark, FOLDER).collect()) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in seen.collect())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_pipeline_equals_brute_force(spark):
    """Each stage redone by plain means over the rows the stage before kept."""
    import duckdb
    import pandas as pd

    import corpus_pipeline as cp
    from chronoframe.llm import tokens
    from test_ops_dedup import components_by_force, fingerprint_by_force

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    vectors, net = quality.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    words = quality.Words()
    rows = [r for r in docs.orderBy("doc_id").collect() if net.scores(quality.pooled([words.of(r.text)], vectors))[0] >= 0.5]
    assert 0 < len(rows) < docs.count()
    fps = [fingerprint_by_force(r.text) for r in rows]
    root = components_by_force(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3])
    rows = [r for k, r in enumerate(rows) if root[k] == k]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([r.asDict() for r in rows]))
    chosen = con.execute(f"SELECT doc_id, count(*) FROM ({mixing.oracle_sql()}) GROUP BY 1").fetchall()
    bpe, texts, want = tokens.ByteBpe(tokens.vocabulary("byte_bpe_50k.json")), {r.doc_id: r.text for r in rows}, {}
    for doc, times in chosen:
        ids = np.array(bpe.whole.encode(texts[doc], add_special_tokens=False).ids + [0], "<i4").tobytes()
        want[doc] = (ids, times)
    got, placed = {}, {}
    for p in cp.run(spark, FOLDER).collect():
        ids, times = want[p.doc_id]
        assert p.doc_tokens == len(ids) // 4 and p.ids_crc32 == zlib.crc32(ids[4 * p.start:4 * (p.start + p.length)])
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
        placed.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert got == {doc: len(ids) // 4 * times for doc, (ids, times) in want.items()}
    for part in placed.values():
        at = 0
        for offset, length in sorted(part):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_queries_with_sql(spark):
    import duckdb

    for name, sql in queries.ORACLE_SQL.items():
        con = duckdb.connect()
        for table in ("documents", "pages", "embeddings"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
        got = queries.QUERIES[name](spark, FOLDER)
        want = con.execute(sql)
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(got.columns)
        assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want.fetchall())), name


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_queries_without_sql_equal_brute_force(spark):
    from tokenizers import Tokenizer

    from chronoframe.llm import tokens
    from test_ops_dedup import components_by_force, fingerprint_by_force
    from test_ops_tokens import check_pieces

    run = lambda n: queries.QUERIES[n](spark, FOLDER).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    bpe, word = (Tokenizer.from_str(tokens.vocabulary(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    ids = {k: bpe.encode(t, add_special_tokens=False).ids for k, t in docs.items()}
    packed = lambda x: np.array(x, "<i4").tobytes()
    at = 0
    for r in sorted(run("op2_token_output"), key=lambda r: r.doc_id):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids[r.doc_id]) + 1, zlib.crc32(packed(ids[r.doc_id] + [2])))
        at += r.n_tokens
    check_pieces(run("op3_packing"), {k: packed(x + [0]) for k, x in ids.items()})
    counts = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in run("op7_token_counts")}
    for k, t in docs.items():
        n = len(word.encode(t, add_special_tokens=False).ids)
        assert counts[k] == (len(t.encode()), n, n > 2048)
    keys = sorted(docs)
    fps = [fingerprint_by_force(docs[k]) for k in keys]
    root = components_by_force(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3])
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in run("op5_simhash_near_dedup")) == [(k, f"{f:016x}", keys[c]) for k, f, c in zip(keys, fps, root)]
    for r in run("op9_media_columns"):
        raw = docs[r.doc_id].encode()
        p = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    scored = run("op4_quality_classifier")
    assert len(scored) == len(docs)
    held = [r.predicted == labels[r.doc_id] for r in scored if r.held_out and r.doc_id in labels]
    assert np.mean(held) >= 0.9


def test_the_rest_works_without_this_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import shutil

    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'breadth_daily' in q and 'pipeline' not in q and not [k for k in q if k[:2] == 'op' and k[2].isdigit()]; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, timeout=120)
    for folder, _, files in os.walk(tmp_path / "r" / "chronoframe"):
        for f in files:
            if f.endswith(".py"):
                assert "chronoframe.llm" not in open(os.path.join(folder, f)).read()
