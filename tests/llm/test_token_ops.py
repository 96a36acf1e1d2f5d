"""Encoders, shards, packing, media and vectors against libraries and brute force."""

import hashlib
import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomspark.llm import byte_bpe, media, packing, queries, topk, wavelet
from loomspark.llm import queries as registered

MIXED = st.lists(st.sampled_from(list("aaBbÉé ß  \n\t's're!?.,<|>=12²́ \x1c\x85\x00ΓΣж中😀_-İ") + [" the", "'s", "'ll", "<|endoftext|>"]), max_size=40).map("".join)


@pytest.fixture(scope="module")
def reference():
    pieces = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={p: i for i, p in enumerate(pieces)}, special_tokens={})
    return bpe, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@settings(max_examples=300, deadline=None)
@given(st.lists(MIXED, min_size=1, max_size=4))
def test_encoders_match_libraries(reference, texts):
    """Texts of one batch, which must not reach into each other."""
    bpe, whole, word = reference
    column = pa.array(["lead", *texts], pa.string()).slice(1)
    encode, decode = byte_bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    pack, word_encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.json")), wavelet.encoder(public_tokenizers.path("word_bpe_49k.json"))[0]
    for found, want in (
        (encode(column), [bpe.encode_ordinary(t) for t in texts]),
        (pack(column), [whole.encode(t, add_special_tokens=False).ids for t in texts]),
        (word_encode(column), [word.encode(t, add_special_tokens=False).ids for t in texts]),
    ):
        ids, offsets = found
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == want
    raw, offsets = decode(*encode(column))
    assert [raw[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [t.encode() for t in texts]


def test_capitals_at_a_text_end(reference):
    """A capital that ends a text, before a text that begins with another byte; a capital before a letter of two such bytes."""
    encode = wavelet.encoder(public_tokenizers.path("word_bpe_49k.json"))[0]
    for texts in (["B", "²"], ["x", "aB", "½"], ["É", "", "中"], ["Bª", "Xµ Bº"], ["1B", "E\u0301"], ["\u0301B\u0301", "\u0301"]):
        ids, offsets = encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [reference[2].encode(t, add_special_tokens=False).ids for t in texts], texts


def test_own_pattern():
    encode, decode = byte_bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), r"\w+|\W+")
    texts = pa.array(["a1 b2!", "", "é x"])
    ids, offsets = encode(texts)
    assert decode(ids, offsets)[0].tobytes() == "a1 b2!é x".encode() and offsets[1] == offsets[2]


def test_byte_bpe(docs, no_docs, texts, reference):
    got = {r.doc_id: r for r in byte_bpe.encode_decode(docs).collect()}
    for i, t in enumerate(texts):
        assert np.frombuffer(got[i].ids, "<u4").tolist() == reference[0].encode_ordinary(t or "") and got[i].decoded == (t or "").encode()
    assert byte_bpe.encode_decode(no_docs).count() == 0


def test_shards(docs, no_docs, texts, reference, spark):
    files = wavelet.write_shards(docs, shard_ids=500)
    got = sorted(tuple(r) for r in wavelet.read_shards(files).collect())
    at, want = 0, []
    for i, t in enumerate(texts):
        ids = reference[2].encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want and files.count() > 3
    assert wavelet.read_shards(wavelet.write_shards(no_docs)).count() == 0
    odd = spark.createDataFrame([(4, "b"), (None, "a"), (4, "a"), (4, "b b"), (4, "b"), (None, None)], "doc_id long, text string").repartition(3)
    back = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in wavelet.read_shards(wavelet.write_shards(odd)).collect())
    assert [b[1] for b in back] == [None, None, 4, 4, 4, 4] and [b[0] for b in back] == [sum(x[2] for x in back[:i]) for i in range(6)]
    assert 1 + sum(a[3] != b[3] for a, b in zip(back[2:], back[3:])) == 3  # equal texts of one id stand together


def test_shards_answer_questions(docs, texts, reference, tmp_path):
    files = wavelet.write_shards(docs, shard_ids=700, to=f"{tmp_path}/shards")
    ids = {i: reference[2].encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    asked = [2, ids[7][0], ids[7][3], 49407, 10**6]
    want = {t: [(i, p) for i, x in ids.items() for p, y in enumerate(x) if y == t] for t in asked}
    assert {r.token: r.n for r in wavelet.count_tokens(files, asked).collect()} == {t: len(w) for t, w in want.items()}
    found = wavelet.locate_tokens(files, asked).collect()
    assert sorted((r.token, r.doc_id, r.place) for r in found) == sorted((t, *w) for t, ws in want.items() for w in ws)
    whole = [y for i in sorted(ids) for y in ids[i]]
    assert all(whole[r.position] == r.token for r in found)
    assert wavelet.read_shards(files.sparkSession.read.parquet(f"{tmp_path}/shards")).count() == len(texts)


def test_shards_are_smaller_than_plain_ids():
    rng = np.random.default_rng(3)
    ids = np.minimum(rng.zipf(1.3, 400_000), 49_000).astype(np.uint16)
    assert len(wavelet.ShardFile(wavelet.WaveletMatrix.build(ids, 16), 0, np.array([len(ids)]), [1]).to_bytes()) < 0.7 * ids.nbytes


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=1500), st.integers(0, 1000), st.sampled_from([1, 100]))
def test_wavelet_matrix(ids, token, times):
    x = np.array(ids * times)
    m = wavelet.ShardFile.from_bytes(wavelet.ShardFile(wavelet.WaveletMatrix.build(x, 10), 0, np.array([len(x)]), [1]).to_bytes()).matrix
    assert (m.all() == x).all() and m.access(len(x) // 2) == x[len(x) // 2]
    token = token if token % 2 else ids[0]
    places = np.flatnonzero(x == token)
    assert m.count(token) == len(places) and m.count(token, 3, 40) == (x[3:40] == token).sum()
    if len(places):
        assert m.select(token, len(places) - 1) == places[-1]
    with pytest.raises(IndexError):
        m.select(token, len(places))


def test_packing(docs, no_docs, texts, reference):
    rows = [r.asDict() for r in packing.pack_documents(docs, block=4).collect()]
    by_doc, windows = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        windows.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids = reference[1].encode(t or "", add_special_tokens=False).ids + [0]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in windows.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= 1024
    assert packing.pack_documents(no_docs).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_windows_of(sizes):
    window = packing.windows_of(sizes, 100)
    assert len(window) == len(sizes) and np.bincount(window, sizes).max(initial=0) <= 100


def test_differencing_is_near_equal():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 257, 900).tolist()
    sums = np.bincount(packing.difference(sizes, 113), sizes, 113)
    assert max(sums) - min(sums) <= 40


def difference_by_lists(sizes, windows):
    """The same method on whole lists of windows, by hand."""
    parts = [(size, -i, [[size, [i]]] + [[0, []] for _ in range(windows - 1)]) for i, size in enumerate(sizes)]
    tie = len(sizes)
    while len(parts) > 1:
        parts.sort(reverse=True, key=lambda p: p[:2])
        (_, _, a), (_, _, b), *parts = parts
        both = sorted(([x[0] + y[0], x[1] + y[1]] for x, y in zip(a, b[::-1])), key=lambda w: -w[0])
        least = both[-1][0]
        both = [[w[0] - least, w[1]] for w in both]
        parts.append((both[0][0], -tie, both))
        tie += 1
    return sorted(sum(sizes[i] for i in w[1]) for w in parts[0][2])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=40), st.integers(1, 9))
def test_differencing_by_hand(sizes, windows):
    got = np.bincount(packing.difference(sizes, windows), sizes, windows)
    assert max(got) - min(got) == (want := difference_by_lists(sizes, windows))[-1] - want[0]


def test_media_round_trip(docs, no_docs, texts):
    got = {r.doc_id: r for r in media.payload_digests(media.store_payloads(docs)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[7].feature == got[8].feature and media.payload_digests(media.store_payloads(no_docs)).count() == 0


def test_media_query_stores_files_and_tiles(spark, docs, texts, tmp_path, monkeypatch):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    written = []
    monkeypatch.setattr(media, "stored", lambda df, name, write=media.stored: written.append(write(df, name)) or written[-1])
    got = {r.doc_id: r for r in queries.op9_media(spark, str(tmp_path)).collect()}
    assert len(written) == 1 and all("media-" in f for f in written[0].inputFiles())
    rows = {r.doc_id: r for r in written[0].collect()}
    assert set(rows) == set(got) == set(range(len(texts)))
    for i, r in rows.items():
        pixels = media.decode(bytes(r.image))
        assert bytes(r.tile_npy) == media.npy_tile(pixels) and (r.height, r.width) == pixels.shape and r.dhash == got[i].feature
        assert hashlib.sha256(r.image).hexdigest() == got[i].media_sha256
    assert [f for f in queries.op9_media(spark, str(tmp_path)).inputFiles() if "media-" in f]


def test_decoders():
    pixels = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert (media.decode(media.encode_pgm(pixels)) == pixels).all()
    assert (media.decode(b"P2 # grey\n4 3\n15\n" + b" ".join(b"%d" % v for v in pixels.ravel())) == pixels).all()
    assert media.decode(b"P1\n3 2\n101\n010").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P4\n3 2\n" + bytes([0b10100000, 0b01000000])).tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P6\n1 1\n255\nabc").tolist() == [[[97, 98, 99]]]
    assert media.decode(b"P5\n1 1\n1000\n\x01\x02").tolist() == [[258]]
    head = lambda size, start, bits: b"BM" + size.to_bytes(4, "little") + bytes(4) + start.to_bytes(4, "little") + (40).to_bytes(4, "little") + (2).to_bytes(4, "little") + (2).to_bytes(4, "little") + (1).to_bytes(2, "little") + bits.to_bytes(2, "little") + bytes(24)
    rows = bytes([1, 2, 3, 4, 5, 6, 0, 0, 7, 8, 9, 10, 11, 12, 0, 0])
    assert media.decode(head(70, 54, 24) + rows).tolist() == [[[9, 8, 7], [12, 11, 10]], [[3, 2, 1], [6, 5, 4]]]
    with pytest.raises(ValueError):
        media.decode(b"GIF89a")


def test_area_resize():
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (12, 18))
    assert np.allclose(media.area_resize(image, 4, 6), image.reshape(4, 3, 6, 3).mean(axis=(1, 3)))
    assert np.allclose(media.area_resize(image, 5, 7).mean(), image.mean())
    assert np.load(io.BytesIO(media.npy_tile(image, 4))).shape == (4, 4)


def test_image_features(spark):
    df = spark.createDataFrame([(1, bytearray(media.encode_pgm(np.eye(9, dtype=np.uint8) * 200))), (2, bytearray(b"no")), (3, None)], "id long, image binary")
    got = {r.id: r for r in media.image_features(df).collect()}
    assert got[1].height == 9 and len(got[1].dhash) == 16 and got[2].dhash is None and got[3].tile_npy is None


def test_top_k(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(700, 9)), 1).astype(np.float32)
    x[10:60] = x[0]
    rows = [(int(i), [float(v) for v in r], 1) for i, r in enumerate(x)]
    rows += [(1000, None, 0), (1001, [float("nan")] * 9, 0), (1050, [None, 1.0], 0), (None, [1.0], 0), (1100, [], 0), (1200, [float("inf")], 0)]
    rows += [rows[3], rows[50], (100, [1.0] * 9, 0)]  # repeated rows and ids, of a query too
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(3)
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect())
    ids = np.array([i for i, e, _ in rows if i is not None and i not in (1000, 1001, 1050, 1200)])
    whole = np.array([np.floor(np.pad(np.float32(e), (0, 9 - len(e))).astype(np.float64) * 256) for i, e, _ in rows if i is not None and i not in (1000, 1001, 1050, 1200)]).astype(np.int64)
    want = []
    for q in np.flatnonzero(ids % 50 == 0):
        s = whole @ whole[q]
        order = [i for i in np.lexsort((ids, -s)) if i != q][:5]
        want += [(int(ids[q]), k + 1, int(ids[i]), int(s[i])) for k, i in enumerate(order)]
    assert got == sorted(want)
    df.where("size(embedding) = 9").write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(db.execute(queries.OP3_SQL).fetchall()) == sorted(tuple(r) for r in queries.op3_topk(spark, str(tmp_path)).collect())
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def exhaustive(rows, ids, x, q_rows, q, k):
    out = []
    for i in range(len(q)):
        scores = x @ q[i]
        out.append([(int(ids[j]), int(scores[j])) for j in np.lexsort((rows, ids, -scores)) if rows[j] != q_rows[i]][:k])
    return out


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 700), st.integers(1, 12), st.sampled_from([3, 400, 2**40]))
def test_block_top(seed, n, width, size):
    rng = np.random.default_rng(seed)
    x = rng.integers(-size, size + 1, (n, width)) if size < 2**30 else rng.integers(-size, size, (n, width)) // 2**rng.integers(0, 40, (n, width))
    rows, ids = rng.permutation(n) * 3, rng.integers(0, n, n)
    q = x[: min(n, 20)] // max(1, size >> 20)
    found, read = topk.block_top(rows, ids, x, rows[: len(q)], q, 5)
    got = [[(int(ids[v]), s) for i, v, s in found if i == j] for j in range(len(q))]
    assert got == exhaustive(rows, ids, x, rows[: len(q)], q, 5) and (read <= 1).all()


@pytest.mark.parametrize("kind, most", [("few large", 0.6), ("clusters", 0.8), ("even", 0.95)])
def test_reading_stops_early(kind, most):
    """Lists are read to the depth at which outsiders cannot qualify, which is less than a full scan."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 64))
    if kind == "few large":
        x = np.where(rng.random((4000, 64)) < 0.02, np.abs(x) * 2000, 0)
    elif kind == "clusters":
        x = x * 0.5 + rng.normal(size=(40, 64))[rng.integers(0, 40, 4000)] * 1.5
    x = np.floor(x * (1 if kind == "few large" else 256)).astype(np.int64)
    rows = np.arange(4000)
    found, read = topk.block_top(rows, rows, x, rows[:100], x[:100], 5)
    assert [[(v, s) for i, v, s in found if i == j] for j in range(100)] == exhaustive(rows, rows, x, rows[:100], x[:100], 5)
    assert read.mean() < most, read.mean()


def test_bars_pass_from_block_to_block(spark, monkeypatch):
    """Blocks of a group after the first are read less deep, and no part or group loses a row."""
    for name, value in (("VECTORS", 60), ("QUERIES", 20), ("STEP", 7), ("GROUPS", 3), ("SEED", 8)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(900, 6)), 1).astype(np.float32)
    got = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>"), F.col("vec_id") % 9 == 0).collect())
    whole = np.floor(x.astype(np.float64) * 256).astype(np.int64)
    want = [(q, n + 1, i, s) for q in range(0, 900, 9) for n, (i, s) in enumerate(exhaustive(np.arange(900), np.arange(900), whole, [q], whole[q : q + 1], 5)[0])]
    assert got == sorted(want)
    rows, q = np.arange(900), whole[:50]
    found, read = topk.block_top(rows, rows, whole, rows[:50], q, 5)
    bar = found[:, 2].reshape(50, 5).min(axis=1)
    again, less = topk.block_top(rows + 1000, rows, whole, rows[:50], q, 5, bar, topk._depth(read))
    assert less.mean() < read.mean() or read.mean() < 0.2
    assert all((again[again[:, 0] == i, 2] >= bar[i]).all() and (again[:, 0] == i).any() for i in range(50))


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registered.queries()) == list(range(1, 11))


def test_sharding(spark):
    from loomspark.llm import sharding

    names = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(names, 1009)
    counts = np.bincount(table, minlength=7)
    assert counts.max() - counts.min() <= 1 and table.min() == 0
    fewer = sharding.lookup_table(names[:-1], 1009)
    stayed = np.mean(fewer[table != 6] == table[table != 6])
    assert stayed > 0.8
    weighted = np.bincount(sharding.lookup_table({"a": 3, "b": 1}, 1009))
    assert abs(weighted[0] - 3 * weighted[1]) <= 4
    df = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "key long, shard string")
    got = sharding.place(df, "key", names, 1009).collect()
    assert got[0].shard == got[1].shard and {r.shard for r in got if r.key is None} == {None} and df.columns == ["key", "shard"]
    assert sharding.place(df.limit(0), "key", names, 1009).count() == 0
    for wrong in ([], {"a": 0}):
        with pytest.raises(ValueError):
            sharding.lookup_table(wrong, 1009)


def filled_by_turns(weights, slots):
    """The table by the words of the method: every shard in turn takes the first free slot of its own order."""
    orders = {}
    for name in weights:
        d = hashlib.blake2b(name.encode(), digest_size=16).digest()
        offset, skip = int.from_bytes(d[:8], "little") % slots, int.from_bytes(d[8:], "little") % (slots - 1) + 1
        orders[name] = [(offset + i * skip) % slots for i in range(slots)]
        assert len(set(orders[name])) == slots
    owner = {}
    while len(owner) < slots:
        for name in sorted(weights):
            for _ in range(weights[name]):
                if len(owner) < slots:
                    owner[next(s for s in orders[name] if s not in owner)] = name
    return owner


def test_placement_by_hand(spark, tmp_path, monkeypatch):
    import xxhash

    from loomspark.llm import sharding

    weights = {"a": 2, "bb": 1, "c": 1}
    owner = filled_by_turns(weights, 101)
    keys = [*range(-5, 300), 2**62, None]
    df = spark.createDataFrame([(k, "x", 1, "n") for k in keys], "doc_id long, _at string, _slot int, _name string")
    got = sharding.place(df, "doc_id", weights, 101)
    assert got.columns == ["doc_id", "_at", "_slot", "_name", "shard"]
    signed = lambda n: n - (1 << 64) if n >> 63 else n
    want = {k: None if k is None else owner[signed(xxhash.xxh64(k.to_bytes(8, "little", signed=True), seed=42).intdigest()) % 101] for k in keys}
    assert {r.doc_id: r.shard for r in got.collect()} == want and got.where("_at = 'x' and _slot = 1 and _name = 'n'").count() == len(keys)
    named = sharding.place(df.drop("_name"), "doc_id", weights, 101, to="_name")
    assert {r.doc_id: r._name for r in named.collect()} == want and named.columns == ["doc_id", "_at", "_slot", "_name"]
    words = spark.createDataFrame([("",), ("é" * 5000,), ("k",)], "key string")
    for r in sharding.place(words, "key", weights, 101).collect():
        assert r.shard == owner[signed(xxhash.xxh64(r.key.encode(), seed=42).intdigest()) % 101]
    # the query itself, whole
    monkeypatch.setattr(queries, "SHARDS", weights)
    spark.range(500).selectExpr("id * 7 as doc_id", "'t' as text").write.parquet(f"{tmp_path}/documents.parquet")
    table = filled_by_turns(weights, 101)
    assert table == {i: sorted(weights)[s] for i, s in enumerate(sharding.lookup_table(weights, 101))}
    whole = sharding.lookup_table(weights)
    for r in queries.op4_sharding(spark, str(tmp_path)).collect():
        assert r.shard == sorted(weights)[whole[signed(xxhash.xxh64(r.doc_id.to_bytes(8, "little", signed=True), seed=42).intdigest()) % sharding.SLOTS]]
