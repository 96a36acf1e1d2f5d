"""Scoring a bounded set of queries against a corpus in the tasks that read it.

The queries' words and weights are few (``QUERY_ROWS`` at most, counted) and go to every task. A task scores
its texts against all queries by array operations over the words both have, and passes on its best k a
query; nothing else of the corpus is shuffled. Larger query sets take the joins of ``lexical`` and ``vector``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.sources.storage import stored
from loomspark.sources.tables import bounded_batches

#: Rows (query, word) that a task may hold.
QUERY_ROWS = 200_000
#: Cells of the matrix (texts x queries) that a task fills at a time.
CELLS = 1 << 22
#: Pairs (word of a text, query that has it) that a task holds at a time; a single text may have more.
ENTRIES = 1 << 21
SCALE = 10**6


class Queries:
    """query ids, their words, and for each word the queries that have it with the number of times."""

    def __init__(self, rows: list[tuple[int, str, int]]):
        self.ids = np.array(sorted({r[0] for r in rows}), np.int64)
        self.words = sorted({r[1] for r in rows})
        place, number = {w: i for i, w in enumerate(self.words)}, {q: i for i, q in enumerate(self.ids.tolist())}
        ordered = sorted((place[w], number[q], n) for q, w, n in rows)
        word, self.query, self.times = np.array(ordered, np.int64).reshape(-1, 3).T
        self.begin = np.searchsorted(word, np.arange(len(self.words) + 1))

    def with_ids(self, more: list[int]) -> Queries:
        """The same with further query ids, of no words."""
        out = Queries([])
        out.ids = np.union1d(self.ids, np.array(more, np.int64))
        out.words, out.begin, out.times = self.words, self.begin, self.times
        out.query = np.searchsorted(out.ids, self.ids)[self.query]
        return out


def collected(asked: DataFrame) -> Queries | None:
    """asked: query_id, term, qtf; None if there are too many rows. A null id asks nothing."""
    rows = asked.where("query_id is not null").select("query_id", "term", "qtf")
    if rows.limit(QUERY_ROWS + 1).count() > QUERY_ROWS:  # counted where they are, so that nothing is collected in vain
        return None
    columns = rows.toArrow()
    return Queries(list(zip(*(c.to_pylist() for c in columns.columns), strict=True)))


def _gram_counts(column: pa.Array, grams: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(text, number of the run, times) of each distinct run of ``grams`` characters of each text, and the runs."""
    points = np.frombuffer("".join(column.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = pc.utf8_length(column).to_numpy().astype(np.int64)
    fits = np.maximum(sizes - grams + 1, 0)
    start = np.repeat(np.cumsum(sizes) - sizes - np.cumsum(fits) + fits, fits) + np.arange(fits.sum())
    code = np.zeros(len(start), np.int64)
    for i in range(grams):  # 21 bits a character, so up to three are exact
        code = code << 21 | points[start + i]
    text, coded = np.repeat(np.arange(len(column)), fits), pa.array(code).dictionary_encode()
    words = ["".join(chr(c >> 21 * i & 0x1FFFFF) for i in reversed(range(grams))) for c in coded.dictionary.to_pylist()]
    key, times = np.unique(text * np.int64(max(1, len(words))) + coded.indices.to_numpy(), return_counts=True)
    return key // max(1, len(words)), key % max(1, len(words)), times, words


def counted_words(texts: DataFrame, words: list[str]) -> DataFrame:
    """texts: doc_id, t (array of words), extra. doc_id, dl (number of its words), w (numbers of those of ``words`` that
    it has, in order), n (how often), extra: the one pass over the texts, written down for frequencies and scores."""
    known = pa.array(words, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            lengths = np.diff(column.offsets.to_numpy())
            number = pc.index_in(column.flatten(), value_set=known).fill_null(-1).to_numpy().astype(np.int64)
            key, times = np.unique((np.repeat(np.arange(len(lengths)), lengths) * len(words) + number)[number >= 0], return_counts=True)
            ends = np.searchsorted(key, np.arange(len(lengths) + 1) * len(words)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (key % max(1, len(words)), times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths.astype(np.int32)), *lists, batch.column(2)], ["doc_id", "dl", "w", "n", "extra"])

    bounded_batches(texts.sparkSession)
    held = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "t", "extra").mapInArrow(run, "doc_id bigint, dl int, w array<int>, n array<int>, extra array<bigint>")
    return stored(held, "counted_words")


def document_frequencies(counted: DataFrame, words: list[str]) -> tuple[np.ndarray, int, float]:
    """Of ``counted_words``: (texts that have each word, number of texts, their mean length). A row a word at most."""
    n, mean = counted.agg(F.count("*"), F.coalesce(F.avg("dl"), F.lit(0.0))).first()
    df = np.zeros(len(words), np.float64)
    for word, texts in counted.select(F.explode("w").alias("w")).groupBy("w").agg(F.count("*")).collect():
        df[word] = texts
    return df, n, mean


def _merged(best: tuple[np.ndarray, np.ndarray], scores: np.ndarray, ids: np.ndarray, k: int) -> None:
    """Puts the best of scores (texts x queries; below nought: no pair) into best (scores, ids: queries x k)."""
    held, names = best
    bar = np.maximum(held[:, -1], np.partition(scores, -k, axis=0)[-k] if k <= len(scores) else -1)
    text, query = np.nonzero((scores >= bar) & (scores >= 0))
    query = np.append(query, np.repeat(np.arange(len(held)), k))
    score, item = np.append(scores[text, query[: len(text)]], held), np.append(ids[text], names)
    order = np.lexsort((item, -score, query))
    order = order[np.arange(len(order)) - np.searchsorted(query[order], query[order]) < k]
    held[:], names[:] = score[order].reshape(-1, k), item[order].reshape(-1, k)


def task_top(docs: DataFrame, queries: Queries, weight: np.ndarray, factor: Callable, settings: int, k: int, extra: float = 0.0, grams: int = 0) -> DataFrame:
    """docs: ``counted_words``; or, with ``grams`` (three at most), doc_id, t (text to be read as runs of so many
    characters). Texts get ``extra`` on top for the queries of their column of that name. weight: for each (word, query)
    of queries; factor(setting, text, times, lengths, n texts) gives the weight of each word of each text. Returns
    setting, query_id, doc_id, score (6 places) of the best k of each task."""
    ids, query, begin, place = queries.ids, queries.query, queries.begin, {w: i for i, w in enumerate(queries.words)}
    schema = "setting int, query_id bigint, doc_id bigint, score double"
    bounded_batches(docs.sparkSession)
    most = ENTRIES
    if not len(ids):
        return docs.sparkSession.createDataFrame([], schema)

    def words_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, number among the queries' words or -1, times, lengths)"""
        if grams:
            text, word, times, names = _gram_counts(part.column("t"), grams)
            known = np.array([place.get(w, -1) for w in names], np.int64)[word] if names else word
            return text, known, times, np.bincount(text, times, part.num_rows)
        column = part.column("w")
        text = np.repeat(np.arange(part.num_rows), np.diff(column.offsets.to_numpy()))
        return text, column.flatten().to_numpy().astype(np.int64), part.column("n").flatten().to_numpy(), part.column("dl").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.full((len(ids), k), -1, np.int64), np.zeros((len(ids), k), np.int64)) for _ in range(settings)]
        step = max(1, min(CELLS // len(ids), 500 if grams else CELLS))
        for batch in batches:
            parts = [batch.slice(low, step) for low in range(0, batch.num_rows, step)][::-1]
            while parts:
                part = parts.pop()
                text, known, times, lengths = words_of(part)
                at = np.flatnonzero(known >= 0)
                sizes = (begin[1:] - begin[:-1])[known[at]]
                if sizes.sum() > most and part.num_rows > 1:
                    half = part.num_rows // 2
                    parts += [part.slice(half), part.slice(0, half)]
                    continue
                doc_ids = part.column("doc_id").to_numpy()
                added = [(i, q) for i, own in enumerate(part.column("extra").to_pylist()) for q in own or ()]
                more = np.array([i for i, _ in added], np.int64), np.searchsorted(ids, np.array([q for _, q in added], np.int64))
                entry = np.repeat(begin[known[at]] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                cell = text[np.repeat(at, sizes)] * len(ids) + query[entry]
                for setting in range(settings):
                    value = factor(setting, text, times, lengths, part.num_rows)
                    scores = np.bincount(cell, weight[entry] * value[np.repeat(at, sizes)], part.num_rows * len(ids)).astype(np.float64).reshape(part.num_rows, -1)
                    scores[more] += extra
                    rounded = np.floor(scores * SCALE + 0.5).astype(np.int64)
                    rounded[scores == 0] = -1
                    _merged(best[setting], rounded, doc_ids, k)
        for setting, (scores, items) in enumerate(best):
            row, at = np.nonzero(scores >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), setting, np.int32)), pa.array(ids[row]), pa.array(items[row, at]), pa.array(scores[row, at] / SCALE)], ["setting", "query_id", "doc_id", "score"])

    columns = ["t", "extra"] if grams else ["dl", "w", "n", "extra"]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *columns).mapInArrow(run, schema)
