"""Repeated substrings by prefix-free parsing.

Every string of ``size`` bytes that starts at two places of the corpus is removed wherever it stands.

1. Anchors. Each window of ``size`` bytes has one anchor: the place inside it where the rolling hash of
   ``gram`` bytes is least (the last such place). Equal windows have equal anchors at equal offsets, so a
   window whose anchor's gram stands at no second anchor is unique. Runs of windows with one anchor are a
   piece; its bytes are its body. One map over the texts writes a row a piece: gram, hash of the body, place.
2. Pieces are counted by gram, before the shuffle first. Unique grams are dropped. A body that stands more than once
   is repeated whole wherever it stands; a gram of one body needs nothing more.
3. Of the grams with several bodies, one copy of each body goes to the task that owns the gram. There,
   prefix-free parsing orders their windows: rolling-hash triggers cut the bytes into
   overlapping phrases; the suffixes of the distinct phrases (dictionary) are ranked by prefix doubling,
   and so are the suffixes of the sequence of phrases (parse); a window's place in corpus order is the
   pair (rank of its phrase's suffix, rank of the parse after it). No phrase suffix is a prefix of
   another, so this order is the order of the texts, and equal windows are neighbours in it.
4. Windows equal to a neighbour give spans of bodies, which are carried to every copy of the body, merged for
   each document and cut out.

A task holds the distinct bodies of one gram, ``HOT`` at most. A gram with more of them (a passage
shorter than ``size`` in ever new surroundings) is too large to be sorted in one place: the hashes of its
bodies' windows are counted by a partial aggregation instead, and joined back, which is exact as well and
costs 32 bytes of shuffle for each such window.

Nothing is broadcast by hint. Documents are told apart by 128 bits of hashes of doc_id and text, bodies by 128 bits
(gram and body), windows by 64 bits beside their gram. Texts are UTF-8; null is empty. Rows with equal
doc_id and text have equal results; a null doc_id is as good as any. Texts shorter than ``size`` lose
nothing. An empty table gives no rows. Extra columns pass through ``deduplicated``; names cannot clash,
as the operator's own columns never stand beside them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import map_arrow, stored, text_or_empty, utf8
from loomspark.llm.rolling import Rolling, chunks, mixed

SIZE = 400
#: Triggers of the phrases: hashes of TRIGGER bytes that are 0 modulo PERIOD.
TRIGGER, PERIOD = 10, 32
#: Distinct bodies of one gram that one task may hold.
HOT = 2048
#: Bytes of bodies that are parsed at a time; a gram's bodies stay together.
PARSED = 1 << 19
#: Windows of a long document that are looked at together.
SEGMENT = 1 << 22
KEY = ["key", "key2"]
_PLACE = np.uint64((1 << 24) - 1)


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours: running minima forwards and backwards in blocks of that width."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, ~np.uint64(0), np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def pieces_of(data: np.ndarray, at: np.ndarray, size: int, gram: int):
    """Of the documents data[at[k]:at[k+1]]: (document, first window, last window, gram hash) of each piece, and the rolling hashes."""
    rolling = Rolling(data)
    grams = rolling.windows(gram)
    if len(grams) < size - gram + 1:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, np.uint64), rolling
    grams = mixed(grams)
    place = np.arange(len(grams), dtype=np.uint64) & _PLACE
    least = _sliding_least((grams & ~_PLACE) | (_PLACE - place), size - gram + 1)
    whole = np.zeros(len(least), bool)
    lengths = np.diff(at)
    for k in np.flatnonzero(lengths >= size):
        whole[at[k] : at[k + 1] - size + 1] = True
    window = np.flatnonzero(whole)
    if not len(window):
        return window, window, window, np.zeros(0, np.uint64), rolling
    anchor = window - (window & int(_PLACE)) + (_PLACE - (least[window] & _PLACE)).astype(np.int64)
    anchor += np.where(anchor < window, int(_PLACE) + 1, 0)
    new = np.ones(len(window), bool)
    new[1:] = (np.diff(anchor) != 0) | (np.diff(window) != 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(window)]]) - 1
    owner = np.searchsorted(at, window[first], "right") - 1
    return owner, window[first], window[last], grams[anchor[first]], rolling


def _first_places(ordered: np.ndarray) -> np.ndarray:
    """For each element of a sorted array, where its equals begin."""
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(ordered)), 0))


def _ranks(symbols: np.ndarray) -> np.ndarray:
    """How many elements are less than each."""
    order = np.argsort(symbols)
    out = np.empty(len(symbols), np.int64)
    out[order] = _first_places(symbols[order])
    return out


def _suffix_ranks(symbols: np.ndarray, ends: np.ndarray, step: int) -> np.ndarray:
    """Ranks of suffixes by prefix doubling. symbols: what the first ``step`` places of each suffix sort by;
    ends: where each suffix's sequence ends. An end sorts first; equal suffixes have equal ranks. A rank is the
    number of lesser suffixes, so one that is told apart, or seen to its end, is final; only others are sorted again."""
    rank, n = _ranks(symbols), len(symbols)
    busy = np.flatnonzero((np.bincount(rank, minlength=n)[rank] > 1) & (ends - np.arange(n) > step))
    while len(busy):
        ahead = busy + step
        inside = ahead < ends[busy]
        key = rank[busy] * np.int64(n + 1) + np.where(inside, rank[np.where(inside, ahead, 0)] + 1, 0)
        order = np.argsort(key)
        busy, key = busy[order], key[order]
        old, new = _first_places(rank[busy]), _first_places(key)
        if (old == new).all():
            break
        rank[busy] += new - old
        step *= 2
        busy = busy[(np.bincount(new, minlength=len(new))[new] > 1) & (ends[busy] - busy > step)]
    return rank


def corpus_order(data: np.ndarray, at: np.ndarray, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the texts data[at[k]:at[k+1]], the pair that sorts like the suffix of its text
    there: the rank of the phrase's suffix in the dictionary and the rank of the parse behind the phrase."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    hashes = mixed(rolling.windows(TRIGGER))
    ends_of = np.repeat(at[1:], np.diff(at))
    hit = np.flatnonzero(hashes % np.uint64(PERIOD) == 0)
    cut[hit[hit + TRIGGER <= ends_of[hit]]] = True
    cut[at] = True
    starts = np.flatnonzero(cut[:n])
    text = np.searchsorted(at, starts, "right") - 1
    following = np.concatenate([starts[1:], [n]])
    last = following >= at[text + 1]
    stops = np.where(last, at[text + 1], following + TRIGGER)

    # the dictionary: one copy of each distinct phrase, one after another
    name = mixed(rolling.raw(starts, stops) + (stops - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ last.astype(np.uint64)
    _, sample, phrase = np.unique(name, return_index=True, return_inverse=True)
    sizes = (stops - starts)[sample]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    source = np.arange(begin[-1]) + np.repeat(starts[sample] - begin[:-1], sizes)
    stop = np.repeat(begin[1:], sizes)
    letters = np.concatenate([data[source].astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)])
    place = np.arange(begin[-1])
    packed = np.zeros(begin[-1], np.uint64)
    for i in range(7):
        packed = packed << np.uint64(9) | np.where(place + i < stop, letters[place + i], np.uint64(0))
    suffix = _suffix_ranks(packed, stop, 7)

    # the parse: phrases by the rank of their first suffix
    order = suffix[begin[:-1]][phrase.reshape(-1)]
    ends = np.searchsorted(text, text, "right")
    parse = _suffix_ranks(order, ends, 1) + 1
    behind = np.where(last, 0, np.append(parse[1:], 0))

    span = following - starts
    holder = np.repeat(np.arange(len(starts)), span)
    return suffix[begin[:-1][phrase.reshape(-1)[holder]] + np.arange(n) - starts[holder]], behind[holder]


def equal_windows(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Whether the window of ``size`` bytes at each place of data[at[k]:at[k+1]] stands at another place too (False where none fits)."""
    rolling = Rolling(data)
    suffix, parse = corpus_order(data, at, rolling)
    fits = np.repeat(at[1:], np.diff(at)) - np.arange(len(data)) >= size
    place = np.flatnonzero(fits)
    place = place[np.lexsort((parse[place], suffix[place]))]
    hashes = rolling.raw(place, place + size)
    same = hashes[1:] == hashes[:-1]
    out = np.zeros(len(data), bool)
    out[place[1:][same]] = True
    out[place[:-1][same]] = True
    return out


def _segments(offsets: np.ndarray, size: int):
    """(first document, last document, first byte, end): whole documents of about 1 MB together, a long one in
    segments that share size - 1 bytes, so each window is in one of them."""
    for first, last in chunks(offsets):
        begin, end = int(offsets[first]), int(offsets[last])
        if end - begin <= SEGMENT + size:
            yield first, last, begin, end
        else:
            for at in range(begin, end - size + 1, SEGMENT):
                yield first, last, at, min(at + SEGMENT + size - 1, end)


def _piece_rows(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """key, key2, gram, body (a hash of the piece's bytes), first, last (windows) of every piece of docs: key, key2, text."""

    def run(batches):
        for batch in batches:
            keys, (data, offsets) = [batch.column(i).to_numpy() for i in range(2)], utf8(batch.column(2))
            for doc, end_doc, begin, end in _segments(offsets, size):
                at = np.clip(offsets[doc : end_doc + 1], begin, end) - begin
                owner, low, high, grams, rolling = pieces_of(data[begin:end], at, size, gram)
                body = mixed(rolling.raw(low, high + size) + (high - low).astype(np.uint64))
                shift = begin - offsets[doc + owner]
                columns = [keys[0][doc + owner], keys[1][doc + owner], grams.view(np.int64), body.view(np.int64), low + shift, high + shift]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "key2", "gram", "body", "first", "last"])

    return map_arrow(docs.select(*KEY, "text"), run, "key bigint, key2 bigint, gram bigint, body bigint, first bigint, last bigint")


def _bodies(docs: DataFrame, samples: DataFrame, size: int) -> DataFrame:
    """gram, body, bytes of the pieces in samples: gram, body, key, key2, first, last."""
    by_doc = samples.groupBy(*KEY).agg(F.collect_list(F.struct("gram", "body", "first", "last")).alias("x")).select(*KEY, *(F.col(f"x.{c}").alias(c) for c in ("gram", "body", "first", "last")))

    def run(batches):
        for batch in batches:
            texts, *lists = batch.columns
            data, offsets = utf8(texts)
            counts = np.diff(lists[0].offsets.to_numpy())
            gram, body, first, last = (c.flatten().to_numpy() for c in lists)
            begin = np.repeat(offsets[:-1], counts)
            raw = memoryview(data)
            found = [bytes(raw[a:b]) for a, b in zip((begin + first).tolist(), (begin + last + size).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(body), pa.array(found, pa.binary())], ["gram", "body", "bytes"])

    joined = docs.select(*KEY, "text").join(by_doc, KEY).select("text", "gram", "body", "first", "last")
    return map_arrow(joined, run, "gram bigint, body bigint, bytes binary")


def _body_runs(owner: np.ndarray, place: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, start, stop) of bytes covered by windows at (owner, place), sorted by both; overlapping ones merged."""
    if not len(owner):
        return owner, place, place
    new = np.ones(len(place), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (np.diff(place) > size)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1
    return owner[first], place[first], place[last] + size


SPANS = "gram bigint, body bigint, start bigint, stop bigint"


def _span_batch(gram: np.ndarray, body: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (gram, body, start, stop)], ["gram", "body", "start", "stop"])


def _parsed_spans(bodies: DataFrame, size: int) -> DataFrame:
    """Spans of repeated windows in bodies, a gram's bodies in one task."""

    def run(batches):
        waiting, group, held = [], [], 0

        def parsed():
            at = np.concatenate([[0], np.cumsum([len(b) for _, _, b in waiting])])
            equal = np.flatnonzero(equal_windows(np.frombuffer(b"".join(b for _, _, b in waiting), np.uint8), at, size))
            owner = np.searchsorted(at, equal, "right") - 1
            owner, start, stop = _body_runs(owner, equal - at[owner], size)
            gram, body = np.array([w[:2] for w in waiting], np.int64).T
            return _span_batch(gram[owner], body[owner], start, stop)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[0] != group[-1][0]:
                    if len(group) > 1:
                        waiting += group
                        held += sum(len(b) for _, _, b in group)
                    group = []
                    if held >= PARSED:
                        yield parsed()
                        waiting, held = [], 0
                if not group or row[1] != group[-1][1]:  # a body that stands in two rows of one key comes twice
                    group.append(row)
        waiting += group if len(group) > 1 else []
        if waiting:
            yield parsed()

    return map_arrow(bodies.repartition("gram").sortWithinPartitions("gram", "body"), run, SPANS)


def _counted_spans(bodies: DataFrame, size: int) -> DataFrame:
    """The same by counting hashes of windows, for grams with too many bodies for one task."""

    def windows(batches):
        for batch in batches:
            gram, body, (data, offsets) = batch.column(0).to_numpy(), batch.column(1).to_numpy(), utf8(batch.column(2))
            hashes = mixed(Rolling(data).windows(size)).view(np.int64)
            fits = np.maximum(np.diff(offsets) - size + 1, 0)
            owner = np.repeat(np.arange(len(fits)), fits)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(fits) - fits, fits)
            columns = [gram[owner], body[owner], hashes[offsets[owner] + place] if len(owner) else owner, place]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["gram", "body", "window", "place"])

    def runs(batches):
        for batch in batches:
            gram, body, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            owner, start, stop = _body_runs(owner, lists.flatten().to_numpy(), size)
            yield _span_batch(gram[owner], body[owner], start, stop)

    rows = stored(map_arrow(bodies.dropDuplicates(["gram", "body"]), windows, "gram bigint, body bigint, window bigint, place bigint"), "windows")
    repeated = stored(rows.groupBy("gram", "window").agg(F.count("*").alias("n")).where("n > 1").select("gram", "window"), "repeated")
    places = rows.join(repeated, ["gram", "window"]).groupBy("gram", "body").agg(F.sort_array(F.collect_list("place")).alias("places"))
    return map_arrow(places, runs, SPANS)


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds key and key2, hashes of doc_id and text."""
    parts = [F.coalesce(F.col("doc_id"), F.lit(-1)), F.col("doc_id").isNull(), text_or_empty()]
    return docs.withColumns({"key": F.xxhash64(*parts), "key2": F.xxhash64(F.lit(7), *parts)}).withColumn("text", text_or_empty())


def repeated_spans(docs: DataFrame, size: int = SIZE, gram: int | None = None, hot: int = HOT) -> DataFrame:
    """docs: key, key2, text. Returns key, key2, spans (array of start, stop in bytes, sorted) of documents that have any."""
    pieces = stored(_piece_rows(docs, size, gram or size // 2), "pieces")
    grams = pieces.groupBy("gram").agg(F.count("*").alias("n"), (F.min("body") < F.max("body")).alias("several")).where("n > 1").select("gram", "several")
    grams = stored(grams, "grams")  # apart from the join, so that a crowded gram's pieces can be split there
    members = stored(pieces.join(grams, "gram"), "members")
    whole = members.where("not several").select(*KEY, F.col("first").alias("start"), (F.col("last") + size).alias("stop"))
    members = members.where("several").select(*KEY, "gram", "body", "first", "last")
    bodies = members.groupBy("gram", "body").agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "first", "last")).alias("x"))
    bodies = stored(bodies.select("gram", "body", "n", "x.*"), "bodies")
    crowd = stored(bodies.groupBy("gram").agg((F.count("*") > hot).alias("hot")), "crowd")
    read = stored(_bodies(docs, bodies, size).join(crowd, "gram"), "read").select("gram", "body", "bytes", "hot")
    spans = _parsed_spans(read.where("not hot").drop("hot"), size).unionByName(_counted_spans(read.where("hot").drop("hot"), size))
    spans = spans.unionByName(bodies.where("n > 1").select("gram", "body", F.lit(0).cast("long").alias("start"), (F.col("last") - F.col("first") + size).alias("stop")))
    carried = members.join(spans, ["gram", "body"]).select(*KEY, (F.col("first") + F.col("start")).alias("start"), (F.col("first") + F.col("stop")).alias("stop"))
    return stored(whole.unionByName(carried).groupBy(*KEY).agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans")), "spans")


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in spans or ():
        if out and s["start"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s["stop"]))
        else:
            out.append((s["start"], s["stop"]))
    return out


def _cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))


def removal_digests(docs: DataFrame, size: int = SIZE, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and text (what is kept; a character that is cut in half goes
    whole) of every row."""
    keyed = _keyed(docs.select("doc_id", "text"))
    spans = repeated_spans(keyed, size, **how)

    def run(batches):
        for batch in batches:
            rows = []
            for text, found in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                merged = _merged(found)
                kept = _cut(raw, merged) if merged else raw
                rows.append((len(raw), sum(b - a for a, b in merged), len(merged), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if merged else text))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    joined = keyed.join(spans, KEY, "left").select(F.col("doc_id").cast("long"), "text", "spans")
    return map_arrow(joined, run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, text string")


def deduplicated(docs: DataFrame, size: int = SIZE, **how) -> DataFrame:
    """docs with the repeated bytes cut out of text; a character that is cut in half goes whole."""
    keyed = _keyed(docs.select("doc_id", "text"))
    spans = repeated_spans(keyed, size, **how)
    rest = [c for c in docs.columns if c != "text"]
    joined = _keyed(docs.select(F.struct(*rest).alias("rest"), F.col("text").alias("given"), "doc_id", "text")).join(spans, KEY, "left")

    def run(batches):
        for batch in batches:
            texts = []
            for text, found in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                merged = _merged(found)
                texts.append(_cut(text.as_buffer().to_pybytes(), merged).decode(errors="ignore") if merged else text.as_py())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["rest", "text"])

    rest_type = joined.schema["rest"].dataType.simpleString()
    cut = map_arrow(joined.select("rest", F.when(F.col("given").isNotNull(), F.col("text")).alias("text"), "spans"), run, f"rest {rest_type}, text string")
    return cut.select(*(F.col("text") if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns))
