"""Byte-level BPE encoding and decoding with a sentencepiece model written straight from a rank file.

The model is serialised field by field: one unknown piece, then a piece for every rank, its bytes spelled
in the printable alphabet, scored by the negative rank; identity normalisation, no dummy prefix, white
space kept. sentencepiece merges the best-scored pair, leftmost first, which is the lowest rank first.
A rank's piece is rank + 1. Each match of the pattern is encoded by itself; a worker keeps the ids of
recent matches (1,000,000 at most, about 200 MB). Decoding maps every id back to its bytes.

Defined results: null and empty texts have no ids and decode to no bytes; repeated rows repeat; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from loomspark.llm.common import map_arrow, text_or_empty
from loomspark.llm.pretokens import ALPHABET, PieceCache, encoded_batch, is_word, packed_ids, ragged, spelled


def read_ranks(path: str) -> list[bytes]:
    """Pieces by rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    out = [b""] * len(pairs)
    for piece, rank in pairs:
        out[int(rank)] = base64.b64decode(piece)
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float | str) -> bytes:
    """One protobuf field: bytes and text length-delimited, floats fixed, integers varint."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


def serialise(pieces: list[bytes]) -> bytes:
    """A sentencepiece ModelProto whose piece of rank r has id r + 1."""
    unknown = _field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2))
    spelt = ["".join(ALPHABET[b] for b in piece) for piece in pieces]
    body = b"".join(_field(1, _field(1, s) + _field(2, float(-rank)) + _field(3, 1)) for rank, s in enumerate(spelt))
    trainer = b"".join(_field(n, v) for n, v in ((3, 2), (4, len(pieces) + 1), (40, 0), (41, (1 << 64) - 1), (42, (1 << 64) - 1), (43, (1 << 64) - 1)))
    normaliser = b"".join(_field(n, v) for n, v in ((1, "identity"), (3, 0), (4, 0), (5, 0)))
    return unknown + body + _field(2, trainer) + _field(3, normaliser)


@cache
def codec(ranks_path: str, pattern: str) -> tuple[Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]]:
    """encode(texts) -> (ids, offsets of each text's ids); decode(ids, offsets) -> (bytes, offsets of each
    text's bytes). Kept by a worker from task to task, with the pieces it knows."""
    import regex
    import sentencepiece

    pieces = read_ranks(ranks_path)
    processor = sentencepiece.SentencePieceProcessor(model_proto=serialise(pieces))
    matches = regex.compile(pattern).findall

    public = pattern == public_tokenizers.PATTERN  # whose cuts are known

    def units(texts: list[str]) -> list[bytes]:
        found = [[t] if public and is_word(t) else matches(t) for t in texts]
        coded = iter(processor.encode([spelled(m) for ms in found for m in ms], out_type=int, num_threads=1))
        return [packed_ids([i - 1 for _ in ms for i in next(coded)]) for ms in found]

    known = PieceCache(units)
    flat = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array(list(map(len, pieces)), np.int64)
    starts = np.cumsum(sizes) - sizes

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if public:
            return encoded_batch(texts, known)
        found = units(texts.to_pylist())
        return np.frombuffer(b"".join(found), "<u4"), np.concatenate([[0], np.cumsum([len(f) // 4 for f in found])]).astype(np.int64)

    def decode(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.concatenate([[0], np.cumsum(sizes[ids])])
        return ragged(flat, starts[ids], sizes[ids]), ends[offsets]

    return encode, decode


def _binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def encode_decode(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), decoded (binary)."""
    ranks_path, pattern = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN

    def run(batches):
        encode, decode = codec(ranks_path, pattern)
        for batch in batches:
            ids, offsets = encode(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(ids.view(np.uint8), 4 * offsets), _binary(*decode(ids, offsets))], ["doc_id", "ids", "decoded"])

    return map_arrow(docs.select("doc_id", text_or_empty().alias("text")), run, "doc_id bigint, ids binary, decoded binary")
