"""Packing documents into training windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into whole windows and a rest; the rest is cut into pieces of at most
``piece`` ids. The rests of one task are dealt, a block at a time, into near-equal windows: every piece
starts as a partial partition with one filled window, and the two partitions with the largest spread are
merged with opposing imbalances (fullest onto emptiest) until one is left. A block starts with the least
number of windows its ids need; while the fullest window holds more than its capacity, the number rises.

Only lengths and checksums are packed; there is no shuffle, and a task holds one block of pieces. A
window's number is (task << 40) + a counter, so a task that runs again gives the same numbers.

Defined results: null and empty texts are the end id alone; a null doc_id stays null; repeated rows are
packed each by itself; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import map_arrow, text_or_empty
from loomspark.llm.pretokens import encoded_batch, library_pieces

CAPACITY = 1024
PIECE = 256
BLOCK_WINDOWS = 256
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, `offset` bigint"


def difference(sizes: list[int] | np.ndarray, windows: int) -> np.ndarray:
    """The window of each size by multiway differencing, deterministic for equal input."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    # A partial partition: the sums of its windows in falling order, less the least of them once all windows
    # are in use; windows that are not in use yet are left implicit. made[k] says how partition n + k came to be:
    # its two parts, whether they met, and the order in which its windows were sorted.
    n, made = len(sizes), []
    heap = [(-int(size), i, np.array([size], np.int64)) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, j, b = heapq.heappop(heap)
        apart = len(a) + len(b) <= windows
        if apart:
            sums = np.concatenate([a, b])
        else:  # the fullest of one onto the emptiest of the other
            sums = np.zeros(windows, np.int64)
            sums[: len(a)] = a
            sums[windows - len(b) :] += b[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        if len(sums) == windows:
            sums -= sums[-1]
        made.append((i, len(a), j, len(b), apart, order))
        heapq.heappush(heap, (-int(sums[0]), n + len(made) - 1, sums))
    out, held = np.zeros(n, np.int64), {heap[0][1]: np.arange(len(heap[0][2]))}
    for k in range(n + len(made) - 1, n - 1, -1):
        i, wide_a, j, wide_b, apart, order = made[k - n]
        window = np.empty(len(order), np.int64)
        window[order] = held.pop(k)
        held[i] = window[:wide_a]
        held[j] = window[wide_a:] if apart else window[windows - wide_b :][::-1]
    for i in range(n):
        out[i] = held[i][0]
    return out


def windows_of(sizes: list[int] | np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The window of each size: near-equal windows of at most ``capacity``; every size is at most ``capacity``."""
    sizes = np.asarray(sizes, np.int64)
    count = int(-(-sizes.sum() // capacity))
    while True:
        window = difference(sizes, count)
        if np.bincount(window, sizes).max(initial=0) <= capacity:
            return window
        count += max(1, count // 128)


@cache
def encoder(path: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """texts -> (ids, offsets of each text's ids), as the tokenizers library encodes them. Kept by a worker
    from task to task, with the pieces it knows."""
    known, marks, _ = library_pieces(path)
    return lambda texts: encoded_batch(texts, known, marks)


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and offsets with the end id after each text."""
    offsets = offsets + np.arange(len(offsets))
    out = np.empty(offsets[-1], "<u4")
    text = np.ones(len(out), bool)
    text[offsets[1:] - 1] = False
    out[offsets[1:] - 1] = end_id
    out[text] = ids
    return out, offsets


class Packer:
    """Takes documents' ids, gives rows of SCHEMA once their windows are known."""

    def __init__(self, first: int, capacity: int, piece: int, block: int):
        self.next, self.capacity, self.piece, self.block = first, capacity, piece, block
        self.rows: list[list[np.ndarray]] = []
        self.waiting = [np.zeros(0, np.int64)] * 6  # doc_id, known, start, length, checksum, ids of the document

    def add(self, doc_id: np.ndarray, known: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> None:
        total = np.diff(offsets)
        full = total // self.capacity
        parts = full + -(-(total % self.capacity) // self.piece)
        doc = np.repeat(np.arange(len(total)), parts)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
        whole = nth < full[doc]
        start = np.where(whole, nth * self.capacity, full[doc] * self.capacity + (nth - full[doc]) * self.piece)
        length = np.where(whole, self.capacity, np.minimum(self.piece, total[doc] - start))
        at = 4 * (offsets[:-1][doc] + start)
        raw = memoryview(ids.astype("<u4").tobytes())
        sums = np.array([zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)], np.int64)
        columns = [doc_id[doc], known[doc], start, length, sums, total[doc]]
        self._give([c[whole] for c in columns], np.arange(int(whole.sum())), np.zeros(int(whole.sum()), np.int64))
        self.waiting = [np.concatenate(pair) for pair in zip(self.waiting, (c[~whole] for c in columns), strict=True)]
        while self.waiting[3].sum() >= self.block * self.capacity:
            self.flush(int(np.searchsorted(np.cumsum(self.waiting[3]), self.block * self.capacity)) + 1)

    def flush(self, pieces: int | None = None) -> None:
        """Packs the first of the waiting pieces."""
        now, self.waiting = [c[:pieces] for c in self.waiting], [c[len(c) if pieces is None else pieces :] for c in self.waiting]
        window = np.unique(windows_of(now[3], self.capacity), return_inverse=True)[1].reshape(-1)
        order = np.argsort(window, kind="stable")
        window, now = window[order], [c[order] for c in now]
        before = np.cumsum(now[3]) - now[3]
        self._give(now, window, before - before[np.searchsorted(window, window)])

    def _give(self, columns: list[np.ndarray], window: np.ndarray, offset: np.ndarray) -> None:
        if len(window):
            self.rows.append([*columns, self.next + window, offset])
            self.next += int(window.max()) + 1

    def batch(self) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*self.rows, strict=True)] or [np.zeros(0, np.int64)] * 8
        self.rows = []
        doc_id = pa.array(columns[0], pa.int64(), mask=~columns[1].astype(bool))
        return pa.RecordBatch.from_arrays([doc_id, *(pa.array(c, pa.int64()) for c in columns[2:])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack_documents(docs: DataFrame, path: str | None = None, end_id: int = 0, capacity: int = CAPACITY, piece: int = PIECE, block: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        task = TaskContext.get()
        packer = Packer((task.partitionId() if task else 0) << 40, capacity, piece, block)
        for batch in batches:
            doc_id = batch.column(0)
            packer.add(doc_id.fill_null(0).to_numpy(), doc_id.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), *with_end(*encode(batch.column(1)), end_id))
            yield packer.batch()
        packer.flush()
        yield packer.batch()

    return map_arrow(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), run, SCHEMA)
