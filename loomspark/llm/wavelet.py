"""Token ids of documents as wavelet matrices, one compressed file for each shard of documents.

A shard's ids are kept as bit planes from the highest bit down; each plane is stably split into its noughts
and ones, so access, counting up to a place (rank) and finding the n-th occurrence (select) walk the planes.
A plane is cut into blocks of 32,768 bits, each compressed by itself, beside a directory of the ones before
each block and of where it begins: a question opens one block a plane, never the whole file.

    magic "LWM2" | planes uint32 | ids uint64 | first id's place in the corpus uint64 | documents uint64
    | ends of documents uint64[] | doc_id int64[] | doc_id known uint8[] padded to 8 | noughts uint64[planes]
    | begins of blocks uint64[planes][blocks + 1] | ones before each uint64[planes][blocks + 1] | blocks

Documents are dealt to tasks by ranges of (doc_id, hash of the text, row) and sorted there; a task cuts them
into shards of about ``shard_ids`` ids (a longer document is a shard of its own) and gives each file as one
binary value. Files are rows of a Parquet table, in the folder given or else in the shared one, so any store
Spark writes to will do, and a lost executor's task writes its rows again. A shard's place in the corpus
needs the number of ids in earlier tasks: one number for each task goes through the driver, never one for
each document.

Defined results: null and empty texts are the end id alone; null doc_ids come first; rows with equal
doc_id come in the order of a hash of their texts, equal texts together; extra columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import map_arrow, stored, text_or_empty
from loomspark.llm.pretokens import WORDS_BETWEEN, encoded_batch, library_pieces

MAGIC = b"LWM2"
HEAD = struct.Struct("<4sIQQQ")
SHARD_IDS = 1 << 19
FILES = "task int, shard int, ids bigint, file binary"
_BITS = 1 << 15
_LEVEL = 1


class WaveletMatrix:
    """Succinct sequence of ids below 2**planes; ``packed`` holds the compressed blocks one after the other."""

    def __init__(self, packed: bytes | memoryview, begins: np.ndarray, ones: np.ndarray, noughts: np.ndarray, size: int):
        self.packed, self.begins, self.ones, self.noughts, self.size = memoryview(packed), begins, ones, noughts, size
        self.unpack = zstandard.ZstdDecompressor().decompress
        self._open: dict[tuple[int, int], np.ndarray] = {}

    @classmethod
    def build(cls, ids: np.ndarray, planes: int) -> WaveletMatrix:
        size, blocks = len(ids), len(ids) // _BITS + 1
        ones, begins, noughts = np.zeros((planes, blocks + 1), np.uint64), np.zeros((planes, blocks + 1), np.uint64), np.zeros(planes, np.uint64)
        pack, parts, at = zstandard.ZstdCompressor(level=_LEVEL, write_checksum=False).compress, [], 0
        now = ids.astype(np.uint16 if planes <= 16 else np.uint32)
        for level in range(planes):
            bit = now & now.dtype.type(1 << (planes - 1 - level)) != 0
            raw = np.zeros(blocks * _BITS // 8, np.uint8)
            bits = np.packbits(bit, bitorder="little")
            raw[: len(bits)] = bits
            ones[level, 1:] = np.cumsum(np.bitwise_count(raw.view("<u8")).reshape(blocks, -1).sum(axis=1, dtype=np.uint64))
            for b, block in enumerate(raw.reshape(blocks, -1)):
                parts.append(pack(block))
                begins[level, b], at = at, at + len(parts[-1])
            begins[level, blocks] = at
            low, high = np.flatnonzero(~bit), np.flatnonzero(bit)  # by place: faster than by mask
            noughts[level] = len(low)
            now = np.concatenate([now[low], now[high]])
        return cls(b"".join(parts), begins, ones, noughts, size)

    def _block(self, level: int, block: int) -> np.ndarray:
        """The words of one block; a thousand opened blocks (4 MB) are kept."""
        words = self._open.get((level, block))
        if words is None:
            if len(self._open) >= 1024:
                self._open.clear()
            a, b = int(self.begins[level, block]), int(self.begins[level, block + 1])
            words = self._open[level, block] = np.frombuffer(self.unpack(self.packed[a:b]), "<u8")
        return words

    def _bits(self, level: int) -> np.ndarray:
        edges = self.begins[level].tolist()
        raw = b"".join(self.unpack(self.packed[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True))
        return np.unpackbits(np.frombuffer(raw, np.uint8), count=self.size, bitorder="little").view(bool)

    def _rank1(self, level: int, end: int) -> int:
        block, rest = divmod(end, _BITS)
        total = int(self.ones[level, block])
        if not rest:
            return total
        words, (word, bit) = self._block(level, block), divmod(rest, 64)
        total += int(np.bitwise_count(words[:word]).sum())
        return total + (int(words[word]) & ((1 << bit) - 1)).bit_count() if bit else total

    def access(self, place: int) -> int:
        out = 0
        for level in range(len(self.noughts)):
            block, rest = divmod(place, _BITS)
            bit = int(self._block(level, block)[rest // 64]) >> (rest % 64) & 1
            before = self._rank1(level, place)
            place = int(self.noughts[level]) + before if bit else place - before
            out = out << 1 | bit
        return out

    def _walk(self, token: int, start: int, end: int) -> tuple[int, int]:
        planes = len(self.noughts)
        for level in range(planes):
            a, b = self._rank1(level, start), self._rank1(level, end)
            if token >> (planes - 1 - level) & 1:
                start, end = int(self.noughts[level]) + a, int(self.noughts[level]) + b
            else:
                start, end = start - a, end - b
            if start == end:
                break
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of token in [start, end)."""
        end = self.size if end is None else min(end, self.size)
        if token < 0 or token >> len(self.noughts):
            return 0
        a, b = self._walk(token, min(start, end), end)
        return b - a

    def select(self, token: int, nth: int) -> int:
        """The place of the nth occurrence (from 0) of token."""
        first, end = self._walk(token, 0, self.size) if 0 <= token < 1 << len(self.noughts) else (0, 0)
        if not 0 <= nth < end - first:
            raise IndexError(nth)
        place, planes = first + nth, len(self.noughts)
        for level in reversed(range(planes)):
            one = token >> (planes - 1 - level) & 1
            place = self._select(level, one, place - int(self.noughts[level]) if one else place)
        return place

    def _select(self, level: int, one: int, nth: int) -> int:
        before = self.ones[level].astype(np.int64)
        if not one:
            before = np.arange(len(before)) * _BITS - before
        block = int(np.searchsorted(before, nth, "right")) - 1
        bits = np.unpackbits(self._block(level, block).view(np.uint8), bitorder="little")
        return block * _BITS + int(np.flatnonzero(bits == one)[nth - int(before[block])])

    def all(self) -> np.ndarray:
        """Every id in order, a plane at a time from the lowest."""
        planes = len(self.noughts)
        now = np.zeros(self.size, np.uint16 if planes <= 16 else np.uint32)
        for level in reversed(range(planes)):
            bit = self._bits(level)
            zero = int(self.noughts[level])
            up = np.empty_like(now)
            up[np.flatnonzero(~bit)], up[np.flatnonzero(bit)] = now[:zero], now[zero:] | now.dtype.type(1 << (planes - 1 - level))
            now = up
        return now


class ShardFile:
    """One shard's bytes: its documents and the wavelet matrix of their ids."""

    def __init__(self, matrix: WaveletMatrix, start: int, ends: np.ndarray, doc_ids: list[int | None]):
        self.matrix, self.start, self.ends, self.doc_ids = matrix, start, ends, doc_ids

    def to_bytes(self) -> bytes:
        m = self.matrix
        known = np.array([d is not None for d in self.doc_ids], np.uint8)
        ids = np.array([d or 0 for d in self.doc_ids], np.int64)
        known_bytes = known.tobytes().ljust(-(-len(known) // 8) * 8, b"\0")
        head = HEAD.pack(MAGIC, len(m.noughts), m.size, self.start, len(ids))
        tables = (self.ends.astype("<u8"), ids.astype("<i8"), known_bytes, m.noughts.astype("<u8"), m.begins.astype("<u8"), m.ones.astype("<u8"))
        return b"".join([head, *map(bytes, tables), m.packed])

    @classmethod
    def from_bytes(cls, data: bytes) -> ShardFile:
        magic, planes, size, start, docs = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard file")
        at = HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        ends, ids, known = take("<u8", docs), take("<i8", docs), take("u1", -(-docs // 8) * 8)
        blocks = size // _BITS + 1
        noughts, begins, ones = take("<u8", planes), take("<u8", planes * (blocks + 1)), take("<u8", planes * (blocks + 1))
        matrix = WaveletMatrix(memoryview(data)[at:], begins.reshape(planes, -1), ones.reshape(planes, -1), noughts, size)
        return cls(matrix, start, ends, [int(i) if k else None for i, k in zip(ids, known[:docs], strict=True)])


@cache
def encoder(path: str) -> tuple[Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], int]:
    """(texts -> (ids, offsets of each text's ids), as the tokenizers library encodes them; number of ids).
    Kept by a worker from task to task, with the pieces it knows."""
    known, marks, size = library_pieces(path)
    return lambda texts: encoded_batch(texts, known, marks, WORDS_BETWEEN, lower=True), size


def write_shards(docs: DataFrame, path: str | None = None, end_id: int = 2, shard_ids: int = SHARD_IDS, to: str | None = None) -> DataFrame:
    """task, shard, ids, file: the shard files, written as a table to the folder ``to``, where they stay, or to
    the shared folder for as long as the application runs; a file's ``start`` is its place in its task."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, vocabulary = encoder(path)
        planes = max(1, (vocabulary - 1).bit_length())
        task, shard, before = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(b for _, b in held), "<u4")
            ends = np.cumsum([len(b) // 4 for _, b in held])
            data = ShardFile(WaveletMatrix.build(ids, planes), before, ends, [d for d, _ in held]).to_bytes()
            return pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())], ["task", "shard", "ids", "file"])

        for batch in batches:
            found, offsets = encode(batch.column(1))
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                ids = found[offsets[k] : offsets[k + 1]].tobytes() + end
                if held and size + len(ids) // 4 > shard_ids:
                    yield flush()
                    held, before, size, shard = [], before + size, 0, shard + 1
                held.append((doc_id, ids))
                size += len(ids) // 4
        if held:
            yield flush()

    order = ["doc_id", "_hash", "_row"]
    dealt = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    files = map_arrow(dealt, run, FILES)
    if to is None:
        return stored(files, "shards", "none")
    files.write.option("compression", "none").parquet(to)
    return docs.sparkSession.read.schema(FILES).parquet(to)


def _starts(files: DataFrame) -> dict[int, int]:
    """The number of ids before each task's."""
    starts, total = {}, 0
    for task, ids in sorted(files.groupBy("task").agg(F.sum("ids")).collect()):
        starts[task], total = total, total + ids
    return starts


def _each_shard(files: DataFrame, rows: Callable[[int, ShardFile], list[np.ndarray | list]], schema: str) -> DataFrame:
    """rows(task, shard) of every file, as columns of bigint."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for task, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                columns = rows(task, ShardFile.from_bytes(data.as_buffer().to_pybytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return map_arrow(files.select("task", "file"), run, schema)


def read_shards(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the files."""
    starts = _starts(files)

    def rows(task, shard):
        raw = memoryview(shard.matrix.all().astype("<u4").tobytes())
        ends = shard.ends.astype(np.int64)
        begins = np.concatenate([[0], ends[:-1]])
        sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
        return [shard.doc_ids, starts[task] + shard.start + begins, ends - begins, sums]

    return _each_shard(files, rows, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def count_tokens(files: DataFrame, tokens: list[int]) -> DataFrame:
    """token, n: occurrences of each distinct token asked for, by rank alone; a shard gives one row a token."""
    asked = sorted(set(tokens))
    counts = _each_shard(files, lambda _, shard: [asked, [shard.matrix.count(t) for t in asked]], "token bigint, n bigint")
    return counts.groupBy("token").agg(F.sum("n").alias("n"))


def locate_tokens(files: DataFrame, tokens: list[int]) -> DataFrame:
    """token, doc_id, place (in its document), position (in the corpus) of every occurrence, by select."""
    starts, asked = _starts(files), sorted(set(tokens))

    def rows(task, shard):
        found = [(t, shard.matrix.select(t, n)) for t in asked for n in range(shard.matrix.count(t))]
        token, at = np.array(found, np.int64).reshape(-1, 2).T
        doc = np.searchsorted(shard.ends, at, "right")
        begins = np.concatenate([[0], shard.ends.astype(np.int64)])[doc]
        return [token, [shard.doc_ids[d] for d in doc], at - begins, starts[task] + shard.start + at]

    return _each_shard(files, rows, "token bigint, doc_id bigint, place bigint, position bigint")
