"""Token files, packing and counts against the tokenizers library."""

import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoframe.llm import common, packing, token_counts, token_output, tokens

ODD = ["", " ", " a b", "a  b", "x \n y\n z ", "a\tb  c d  e", "<|endoftext|> hi", "it's we've 'S I'll", "é日本 語 😀 😀", "a \r\n b", "x   y 　 z", "12 34 5a6 !!x ..", "á b\u0085 c", "a , b. ʰ, x² ª. . ,", "ΑΣ ΟΔΟΣ", "İstanbul ŉ ǅ", "ﬁ ﬀ",
       "<|startoftext|>x<|endoftext|>", "\x1ca\x0bb", "ſt ß ẞ", "×÷ ª º ² ½", "é Å", "x " * 3000, "ÉCOLE L'ÉTÉ ŒUVRE"]


@pytest.fixture(scope="module")
def byte_bpe():
    return tokens.ByteBpe(tokens.vocabulary("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def word_counts():
    return tokens.WordCounts(tokens.vocabulary("word_bpe_49k.json"), {"the": 1})


def ids_of(bpe, text):
    return np.array(bpe.whole.encode(text, add_special_tokens=False).ids, "<i4").tobytes()


def test_encoder_on_odd_texts(byte_bpe, word_counts):
    for text in ODD:
        assert byte_bpe.encode(text) == ids_of(byte_bpe, text), text
        assert word_counts.count(text) == len(word_counts.whole.encode(text, add_special_tokens=False).ids), text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_encoder_on_any_text(byte_bpe, word_counts, text):
    text = text.encode("utf-8", "ignore").decode()
    assert byte_bpe.encode(text) == ids_of(byte_bpe, text)
    assert word_counts.count(text) == len(word_counts.whole.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" abZé'ls1.,!\n\t<|>ª²œ", max_size=40))
def test_encoder_on_close_texts(byte_bpe, word_counts, text):
    assert byte_bpe.encode(text) == ids_of(byte_bpe, text)
    assert word_counts.count(text) == len(word_counts.whole.encode(text, add_special_tokens=False).ids)


def test_caches_stay_bounded(byte_bpe):
    small = tokens.ByteBpe(tokens.vocabulary("byte_bpe_50k.json"), most=5)
    text = " ".join(f"w{k}," for k in range(100))
    assert small.encode(text) == ids_of(byte_bpe, text) and len(small.words) <= 6


def documents(spark):
    rows = [(9, "later text"), (2, None), (5, "same"), (5, "same"), (5, "other"), (None, "no id"), (1, "x " * 2000), (3, "")]
    return spark.createDataFrame([(a, b, 1, "t") for a, b in rows], "doc_id long, text string, start int, tokens string")


def test_token_files_round_trip(spark, byte_bpe):
    path = common.scratch(spark, "test-tokens")
    token_output.write(documents(spark), path)
    files = token_output.read(spark, path)
    got = sorted(token_output.digests(files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 5, 5, 5, 9]
    texts = ["no id", "x " * 2000, "", "", "other", "same", "same", "later text"]
    coded = [ids_of(byte_bpe, t) + struct.pack("<i", 2) for t in texts]
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((r.doc_id or 0, len(x) // 4, zlib.crc32(x)) for r, x in zip(got, coded))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    plan = files.where("doc_id = 5")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)]" in plan and files.where("doc_id = 5").count() == 3


def test_token_files_have_the_format(spark):
    path = common.scratch(spark, "test-tokens")
    docs = spark.range(48_000).selectExpr("id AS doc_id", "sha2(cast(id AS string), 512) AS text")
    token_output.write(docs, path, row_index_stride=1000, stripe_bytes=1 << 20)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = [f.getPath() for f in folder.getFileSystem(conf).listStatus(folder) if f.getPath().getName().endswith(".orc")]
    stripes, rows, runs, blooms = 0, 0, 0, 0
    for f in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(f, jvm.org.apache.orc.OrcFile.readerOptions(conf))
        rows, found = rows + reader.getNumberOfRows(), list(reader.getStripes())
        assert reader.getRowIndexStride() == 1000 and list(reader.getSchema().getFieldNames()) == ["doc_id", "part", "pos", "n_tokens", "tokens"]
        for stripe in found:
            footer, stripes = reader.rows().readStripeFooter(stripe), stripes + 1
            streams = [(s.getKind().toString(), s.getColumn()) for s in footer.getStreamsList()]
            assert {("ROW_INDEX", k) for k in range(1, 7)} <= set(streams)
            blooms += ("BLOOM_FILTER_UTF8", 1) in streams
            runs += all(footer.getColumns(k).getKind().toString() == "DIRECT_V2" for k in (1, 4, 6))  # run-length encoding, second version
    assert rows == 48_000 and stripes > len(files) and runs == blooms == stripes


def test_token_files_of_an_empty_table(spark):
    path = common.scratch(spark, "test-tokens")
    token_output.write(documents(spark).limit(0), path)
    assert token_output.digests(token_output.read(spark, path)).count() == 0


def check_pieces(rows, ids, capacity=1024):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        own = ids[r.doc_id]
        assert r.length > 0 and r.doc_tokens == len(own) // 4 and r.ids_crc32 == zlib.crc32(own[4 * r.start:4 * (r.start + r.length)])
    for k, own in ids.items():
        at = 0
        for r in sorted(by_doc[k], key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(own) // 4
    short = 0
    for part in by_seq.values():
        at = 0
        for r in sorted(part, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity and at & (at - 1) == 0
        short += at < capacity
    return short


def test_packing_keeps_every_id_once(spark, byte_bpe):
    r = np.random.default_rng(4)
    texts = {k: " ".join(["word", "longer", "é"][x] for x in r.integers(0, 3, int(r.integers(0, 1500)))) for k in range(120)} | {500: None, 501: "", 502: "z " * 9000}
    df = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "doc_id long, text string, sequence_id int").repartition(3)
    ids = {k: ids_of(byte_bpe, t or "") + struct.pack("<i", 0) for k, t in texts.items()}
    rows = packing.pack(df, batch_tokens=20_000).collect()
    assert check_pieces(rows, ids) <= 11 * 40
    assert packing.pack(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    assert sorted((x.doc_id or 0, x.length) for x in packing.pack(twice).collect()) == [(0, 2), (1, 2), (1, 2)]
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(df, capacity=1000)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60))
def test_plan_fills_and_balances(lengths):
    pieces = packing.plan(lengths, 64)
    used, seen = {}, {}
    for d, s, n, q, o in pieces:
        used[q] = used.get(q, 0) + n
        seen.setdefault(d, []).append((s, n))
        assert 0 < n <= 64
    assert all(v <= 64 and v & (v - 1) == 0 for v in used.values()) and sum(v < 64 for v in used.values()) <= 6
    for d, n in enumerate(lengths):
        assert sum(m for _, m in seen[d]) == n


def plan_by_hand(lengths, capacity, quadratic):
    """The rule word for word, every sequence looked at for every document."""
    whole = [(d, s, capacity) for d, n in enumerate(lengths) for s in range(0, n - n % capacity, capacity)]
    rests = sorted(((n % capacity, d) for d, n in enumerate(lengths) if n % capacity), key=lambda r: (-r[0], r[1]))
    total = sum(n for n, _ in rests)
    room = [capacity] * (total // capacity) + [1 << k for k in reversed(range(capacity.bit_length())) if total % capacity >> k & 1]
    cost, out = [0.0] * len(room), [(d, s, n, k) for k, (d, s, n) in enumerate(whole)]
    for n, d in rests:
        start = lengths[d] - n
        while n:
            fits = [k for k in range(len(room)) if room[k] >= n]
            k = min(fits, key=lambda k: (cost[k], k)) if fits else min((k for k in range(len(room)) if room[k] == max(room)), key=lambda k: (cost[k], k))
            take = min(n, room[k])
            out.append((d, start, take, len(whole) + k))
            room[k], cost[k], n, start = room[k] - take, cost[k] + take + quadratic * take * take, n - take, start + take
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 200), max_size=40))
def test_plan_follows_the_costs(lengths):
    got = sorted(p[:4] for p in packing.plan(lengths, 64, 1.0, 1 / 16))
    assert got == sorted(plan_by_hand(lengths, 64, 1 / 16))


def test_descending_documents_go_to_the_cheapest_sequence():
    pieces = packing.plan([6, 5, 5, 4, 4, 8], 8)
    first = {d: q for d, s, n, q, o in pieces if s == 0}
    assert first[5] == 0 and first[0] != first[1] and first[1] != first[2]


def test_counts(spark, word_counts):
    texts = [*ODD, None]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in token_counts.count(df, limit=3).collect()}
    for k, t in enumerate(texts):
        n = len(word_counts.whole.encode(t or "", add_special_tokens=False).ids)
        assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len((t or "").encode()), n, n > 3)
    assert token_counts.count(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a b", 5), (1, "a b", 5), (None, "a b", 5), (2, "a " * 50_000, 5)], "doc_id long, text string, n_bytes long")
    rows = sorted(((r.doc_id or 0), r.n_bytes, r.n_tokens) for r in token_counts.count(twice).collect())
    assert rows == [(0, 3, 2), (1, 3, 2), (1, 3, 2), (2, 100_000, 50_000)]


def test_frequent_pieces_come_from_all_documents(spark):
    df = spark.createDataFrame([(k, "common " * 3 + f"rare{k} " + ("late" if k > 180 else "")) for k in range(200)], "doc_id long, text string").repartition(5)
    got = [(r.piece, r.n) for r in token_counts.frequent_pieces(df, 4, held=64).collect()]
    assert got[0] == ("common", 600) and got[1][0] == "late" and got[1][1] <= 19
