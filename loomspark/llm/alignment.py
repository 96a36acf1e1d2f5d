"""Cross-tokenizer alignment: two tokenizers' tokens of the same bytes, grouped where both end.

Tokenizer A (byte-level BPE) encodes a space and the text, tokenizer B (sentencepiece) the text, before which it sets
a space itself. A batch's texts are cut before each space that follows a letter, a digit or punctuation; there both
tokenizers end a token, and neither looks across. So each distinct segment is encoded and aligned once a task.

Alignment is DuckDB's work, inside each Arrow batch: the tokens of both sides are tables of intervals (place, first byte,
end byte, id). An ASOF join, on first bytes before the end, finds the token of the other side that lies over a token's
last byte; the two end together if their ends are equal. A window sum of those ends numbers the groups.

Tokens that end together hold one another's bytes as an ending. So the pairs that can be linked are few, a few for each
token, and are known from the vocabularies (``Pairs``): counts of pairs are one array of that size. Tasks add up their
own and Spark adds up the tasks', then the sums are broadcast to the pass that rates each document's links.

Defined results: null and empty texts have no tokens, and neither have texts whose B tokens do not give back their
bytes (such as those with U+2581); texts that spell a special token are plain text; rows that repeat count again;
a null doc_id stays null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import map_arrow, stored, text_or_empty, utf8
from loomspark.llm.pretokens import ALPHABET, OTHER, S, W, PieceCache, encoded_batch, kinds_of, packed_ids, ragged

#: Segments that a worker keeps, aligned, from batch to batch: up to twice as many, about 300 bytes each.
KEPT = 100_000


class Vocabulary:
    """The bytes of each id."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.array(list(map(len, tokens)), np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return ragged(self.flat, self.starts[ids], self.sizes[ids])


@cache
def tokenizer_a(path: str):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    byte = {c: b for b, c in enumerate(ALPHABET)}
    tokens = [b""] * whole.get_vocab_size()
    for token, i in whole.get_vocab().items():
        tokens[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    known = PieceCache(lambda pieces: [packed_ids(e.ids) for e in whole.encode_batch(pieces, add_special_tokens=False)], 50_000)
    return Vocabulary(tokens), lambda segments: encoded_batch(segments, known)


@cache
def tokenizer_b(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    tokens = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            tokens.append(bytes([int(piece[3:5], 16)]))
        else:
            tokens.append(b"" if model.is_unknown(i) or model.is_control(i) else piece.replace("▁", " ").encode())
    space = model.piece_to_id("▁")

    def encode(segments: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Segments begin with a space, which the model sets itself; of nothing it makes nothing."""
        found = model.encode([s[1:] for s in segments.to_pylist()], num_threads=1)
        found = [ids or [space] for ids in found]
        return np.array([i for ids in found for i in ids], np.int64), np.concatenate([[0], np.cumsum(list(map(len, found)), dtype=np.int64)])

    return Vocabulary(tokens), encode


class Pairs:
    """The pairs of ids of which one's bytes are an ending of the other's, numbered in order of (a, b)."""

    def __init__(self, a: Vocabulary, b: Vocabulary):
        def by_token(v: Vocabulary) -> dict[bytes, list[int]]:
            out: dict[bytes, list[int]] = {}
            for i, t in enumerate(v.tokens):
                if t:
                    out.setdefault(t, []).append(i)
            return out

        of_a, of_b = by_token(a), by_token(b)
        codes = [i * len(b.tokens) + j for t, ids in of_a.items() for k in range(len(t)) for j in of_b.get(t[k:], ()) for i in ids]
        codes += [i * len(b.tokens) + j for t, ids in of_b.items() for k in range(1, len(t)) for i in of_a.get(t[k:], ()) for j in ids]
        self.wide = len(b.tokens)
        self.codes = np.unique(np.array(codes, np.int64))

    def number(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.codes, a * self.wide + b)

    def best_of_b(self, counts: np.ndarray) -> np.ndarray:
        """For each pair, the highest count of a pair of its B id."""
        b = self.codes % self.wide
        best = np.zeros(self.wide, np.int64)
        np.maximum.at(best, b, counts)
        return best[b]


@cache
def pairs_of(path_a: str, path_b: str) -> Pairs:
    return Pairs(tokenizer_a(path_a)[0], tokenizer_b(path_b)[0])


def segments_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(segments of all texts, index of each text's first segment and the end). A segment ends where a letter, a digit or
    punctuation meets a space."""
    cut = np.zeros(len(data) + 1, bool)
    kind = kinds_of(data)
    ends = (kind != S) & (kind != W) & (kind != OTHER)
    cut[1 : len(data)] = ends[:-1] & (kind[1:] == S)
    cut[offsets] = True
    starts = np.flatnonzero(cut[: len(data)])
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))), np.searchsorted(starts, offsets)


#: Tokens of x, in order: the token of y over its last byte, whether the two end together, and the group, which is the
#: number of such ends before it.
OVER = """
SELECT i, other, together, sum(together::INTEGER) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) - together::INTEGER AS grp
FROM (SELECT x.i, y.id AS other, x.hi = y.hi AS together FROM {x} x ASOF JOIN {y} y ON x.hi > y.lo) ORDER BY i
"""


def intervals(ids: np.ndarray, vocabulary: Vocabulary) -> pa.Table:
    """i, lo, hi, id: tokens that follow one another, as ranges of their bytes."""
    ends = np.cumsum(vocabulary.sizes[ids])
    return pa.table({"i": np.arange(len(ids)), "lo": ends - vocabulary.sizes[ids], "hi": ends, "id": ids})


def strung(offsets: np.ndarray, strings: pa.Array, mark: str) -> pa.Array:
    """The strings of each range of offsets, joined."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), strings), mark)


#: (whole, n_a, n_b, n_groups, groups, numbers of the linked pairs) of a segment.
Segment = tuple[bool, int, int, int, str, bytes]


class Aligner:
    """Aligns segments, each distinct one once while it is kept."""

    def __init__(self, path_a: str, path_b: str):
        import duckdb

        (self.a, self.encode_a), (self.b, self.encode_b) = tokenizer_a(path_a), tokenizer_b(path_b)
        self.pairs = pairs_of(path_a, path_b)
        self.duck = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        self.kept = PieceCache(self._aligned, KEPT)

    def _aligned(self, found: list[str]) -> list[Segment]:
        out: list[Segment] = []
        for low in range(0, len(found), 1 << 16):
            out += self._some(pa.array(found[low : low + (1 << 16)], pa.string()))
        return out

    def _some(self, segments: pa.Array) -> list[Segment]:
        ids_a, at_a = self.encode_a(segments)
        ids_b, at_b = self.encode_b(segments)
        ids_a = ids_a.astype(np.int64)
        data, offsets = utf8(segments)
        back, ends = self.b.bytes_of(ids_b), np.concatenate([[0], np.cumsum(self.b.sizes[ids_b])])[at_b]
        same = np.diff(ends) == np.diff(offsets)
        if len(back) != len(data) or not same.all() or not (back == data).all():
            same &= np.array([back[p:q].tobytes() == data[r:t].tobytes() for p, q, r, t in zip(ends[:-1], ends[1:], offsets[:-1], offsets[1:], strict=True)], bool)
        out: list[Segment] = [(False, 0, 0, 0, "", b"")] * len(segments)
        held = np.flatnonzero(same)
        if not len(held):
            return out
        n_a, n_b = np.diff(at_a)[held], np.diff(at_b)[held]
        ids_a, ids_b = ragged(ids_a, at_a[held], n_a), ragged(ids_b, at_b[held], n_b)
        # segments one after the other: both sides end there, so no group reaches from one into the next
        self.duck.register("a", intervals(ids_a, self.a))
        self.duck.register("b", intervals(ids_b, self.b))
        over_a, over_b = (self.duck.sql(OVER.format(x=x, y=y)).fetchnumpy() for x, y in ("ab", "ba"))
        together = np.asarray(over_a["together"], bool)
        linked = np.bincount(np.repeat(np.arange(len(held)), n_a)[together], minlength=len(held))
        cuts = np.concatenate([[0], np.cumsum(linked)])
        sides = [strung(np.searchsorted(np.asarray(x["grp"], np.int64), np.arange(cuts[-1] + 1)), pa.array(ids).cast(pa.string()), ",") for x, ids in ((over_a, ids_a), (over_b, ids_b))]
        groups = strung(cuts, pc.binary_join_element_wise(*sides, "|"), ";").to_pylist()
        raw = self.pairs.number(ids_a[together], np.asarray(over_a["other"], np.int64)[together]).astype(np.int32).tobytes()
        whole = zip(held.tolist(), n_a.tolist(), n_b.tolist(), linked.tolist(), groups, (4 * cuts).tolist(), strict=False)
        for k, a, b, n, text, at in whole:
            out[k] = (True, a, b, n, text, raw[at : at + 4 * n])
        return out

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
        """Of each text: (n_a, n_b, n_groups) as rows, groups (null without tokens), and the numbers of the linked pairs of
        all texts with the offsets of each."""
        spaced = pc.binary_join_element_wise(pa.scalar(" "), texts, "")
        data, offsets = utf8(spaced)
        pieces, first = segments_of(data, offsets)
        coded = pieces.dictionary_encode()
        known = self.kept.many(coded.dictionary.to_pylist())
        which = coded.indices.to_numpy()
        counts = np.array([k[:4] for k in known], np.int64).reshape(-1, 4)
        sums = np.diff(np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(counts[which], axis=0)])[first], axis=0)
        none = (np.diff(offsets) == 1) | (sums[:, 0] < np.diff(first))
        used = ~np.repeat(none, np.diff(first))
        sums[none] = 0
        groups = strung(np.concatenate([[0], np.cumsum(np.diff(first))]), pa.array([k[4] for k in known], pa.string()).take(pa.array(which)), ";")
        sizes = counts[:, 3]
        pairs = ragged(np.frombuffer(b"".join([k[5] for k in known]), np.int32), (np.cumsum(sizes) - sizes)[which[used]], sizes[which[used]])
        return sums[:, 1:], pc.if_else(pa.array(none), pa.scalar(None, pa.string()), groups), pairs, np.concatenate([[0], np.cumsum(sums[:, 3])])


@cache
def aligner(path_a: str, path_b: str) -> Aligner:
    """Kept by a worker from task to task."""
    return Aligner(path_a, path_b)


ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups string, pairs binary"


def _paths(path_a: str | None, path_b: str | None) -> tuple[str, str]:
    return path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, with_groups: bool = True) -> DataFrame:
    """ALIGNED, a row a document: groups as `a1,a2|b1;a3|b2` in order (null without tokens; or its SHA-256, if not
    ``with_groups``), pairs as 32-bit numbers (of ``Pairs``), one for each link."""
    paths = _paths(path_a, path_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, groups, pairs, offsets = aligner(*paths).batch(batch.column(1))
            if not with_groups:
                groups = pa.array(["" if g is None else hashlib.sha256(g.encode()).hexdigest() for g in groups.to_pylist()], pa.string())
            held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(4 * offsets), pa.py_buffer(np.ascontiguousarray(pairs))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in counts.T), groups, held], ["doc_id", "n_a", "n_b", "n_groups", "groups", "pairs"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), run, ALIGNED)


def pair_counts(rows: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """pair, n: the links of the whole corpus by pair; a task gives one row for each pair that it met."""
    paths = _paths(path_a, path_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(pairs_of(*paths).codes), np.int64)
        for batch in batches:
            counts += np.bincount(utf8(batch.column(0))[0].view(np.int32), minlength=len(counts))
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(counts[met])], ["pair", "n"])

    return map_arrow(rows.select("pairs"), run, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def link_digests(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    paths = _paths(path_a, path_b)
    rows = stored(aligned(docs, *paths, with_groups=False), "aligned")
    pairs = pairs_of(*paths)
    counts = np.zeros(len(pairs.codes), np.int64)
    found = pair_counts(rows, *paths).toArrow()  # bounded by the vocabularies, not by the corpus
    counts[found["pair"].to_numpy()] = found["n"].to_numpy()
    held = docs.sparkSession.sparkContext.broadcast((counts, counts == pairs.best_of_b(counts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = held.value
        for batch in batches:
            data, offsets = utf8(batch.column(batch.schema.names.index("pairs")))
            linked, at = data.view(np.int32), offsets // 4
            sums = [np.diff(np.concatenate([[0], np.cumsum(x[linked])])[at]) for x in (best.astype(np.int64), counts)]
            mine = [batch.column(batch.schema.names.index(c)) for c in ("doc_id", "n_a", "n_b", "n_groups")]
            yield pa.RecordBatch.from_arrays([*mine, pa.array(np.diff(at)), *map(pa.array, sums), batch.column(batch.schema.names.index("groups"))], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return map_arrow(rows, run, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
