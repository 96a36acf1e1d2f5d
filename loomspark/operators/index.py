"""A lexical index that is kept: built once for a corpus, found again by a fingerprint, read by the query's words only.

Postings lie in Parquet, in folders by a hash of the word, so a search opens only the folders of its words and never the
texts. A row is a word's postings in one block of texts, as lists; blocks are cut by the tasks that read the texts, so the
postings are shuffled once, as lists, on the way to their folders. A search deals its words' rows out by block, scores a
block in one task and passes on its best k a query, so pairs of query and text are not shuffled. The fingerprint is a sum over the rows' hashes: rows may come in any order and from any number of files, and any
row that is added, lost or changed gives another index. Files that have not been touched since the index was built are
known by their names, sizes and times, so a corpus of files is not even read to be recognised.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.operators.lexical import PLACES, idf
from loomspark.operators.scoring import SCALE, Queries, collected
from loomspark.sources.tables import bounded_batches

#: Folders of postings.
BUCKETS = 64
#: Words of the texts of a block, about: a task holds them, and a search their postings of the queries' words.
BLOCK_WORDS = 2_000_000
#: The way in which postings lie; another one is another index.
LAYOUT = "blocks"


def fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> str:
    """A key of the rows of docs, in whatever order they are. Nulls count, and rows that repeat count again."""
    pair = (F.xxhash64(F.col(doc_id), F.col(text)), F.xxhash64(F.lit(1), F.col(text), F.col(doc_id)))
    row = docs.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).alias(f"h{i}") for i, h in enumerate(pair))).first()
    return hashlib.sha256("|".join(str(int(x)) for x in row).encode()).hexdigest()[:32]


def files_key(docs: DataFrame) -> str | None:
    """A key of the files that docs reads whole, by name, size and time; None where it does not read files."""
    names = sorted(docs.inputFiles())
    if not names:
        return None
    spark = docs.sparkSession
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), hashlib.sha256()
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        out.update(f"{name}|{status.getLen()}|{status.getModificationTime()}\n".encode())
    return out.hexdigest()[:32]


@dataclass(frozen=True)
class Index:
    """Of one corpus: postings (term, block, doc_ids, dls, tfs; folders by bucket), n texts, their mean length."""

    postings: DataFrame
    n: int
    mean: float
    key: str
    built: bool

    def search(self, queries: DataFrame, query_tokens: Column, k: int, k1: float = 1.2, b: float = 0.5) -> DataFrame:
        """query_id, rank, doc_id, score, as ``lexical.bm25`` gives them. Only folders of the queries' words are read."""
        asked = queries.where("query_id is not null").select("query_id", F.explode(query_tokens).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        folders = [r[0] for r in asked.select(bucket_of(F.col("term")).alias("bucket")).distinct().collect()]  # BUCKETS rows at most
        rows = self.postings.where(F.col("bucket").isin(folders)).join(asked.select("term").distinct(), "term", "left_semi")
        few = collected(asked)
        scored = self._in_joins(rows, asked, k1, b) if few is None else self._in_blocks(rows, few, k, k1, b)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")

    def _in_blocks(self, rows: DataFrame, few: Queries, k: int, k1: float, b: float) -> DataFrame:
        frequency = dict(map(tuple, rows.groupBy("term").agg(F.sum(F.size("doc_ids"))).collect()))  # the queries' words
        n, mean = self.n, max(self.mean, 1e-300)
        weight = np.array([np.log1p((n - frequency.get(w, 0) + 0.5) / (frequency.get(w, 0) + 0.5)) for w in few.words])
        word = np.repeat(np.arange(len(few.words)), np.diff(few.begin))
        own = np.argsort(few.query, kind="stable")  # (word, query) rows by query
        ends = np.searchsorted(few.query[own], np.arange(len(few.ids) + 1))
        ids, words, times = few.ids, pa.array(few.words, pa.string()), few.times
        doc_type = rows.schema["doc_ids"].dataType.elementType.simpleString()

        def best(block: pa.Table) -> pa.Table:
            """The block's k best texts of each query."""
            block = block.combine_chunks()
            at = pc.index_in(block["term"], value_set=words).to_numpy()
            lists = [block[c].combine_chunks() for c in ("doc_ids", "dls", "tfs")]
            low = np.concatenate([[0], np.cumsum(pc.list_value_length(lists[0]).to_numpy())])
            doc_ids, dl, tf = lists[0].flatten(), lists[1].flatten().to_numpy(), lists[2].flatten().to_numpy()
            names = doc_ids.unique()
            names = names.take(pc.array_sort_indices(names))  # numbers in the order of the ids, for ties
            doc, value = pc.index_in(doc_ids, value_set=names).to_numpy(), tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean))
            place = np.full(len(weight), -1)
            place[at] = np.arange(len(at))
            out = []
            for query in range(len(ids)):
                mine = own[ends[query] : ends[query + 1]]
                mine = mine[place[word[mine]] >= 0]
                if not len(mine):
                    continue
                total = np.zeros(len(names))
                for row in mine:
                    part = slice(low[place[word[row]]], low[place[word[row]] + 1])
                    np.add.at(total, doc[part], times[row] * weight[word[row]] * value[part])
                found = np.flatnonzero(total)
                score = np.floor(total[found] * SCALE + 0.5)
                if len(found) > k:
                    keep = score >= np.partition(score, -k)[-k]
                    found, score = found[keep], score[keep]
                first = np.lexsort((found, -score))[:k]
                out.append((np.full(len(first), ids[query]), found[first], score[first] / SCALE))
            query, item, score = (np.concatenate(c) for c in zip((np.zeros(0, np.int64),) * 2 + (np.zeros(0),), *out, strict=True))
            return pa.table({"query_id": query, "doc_id": names.take(pa.array(item)), "score": score})

        return rows.groupBy("block").applyInArrow(best, f"query_id bigint, doc_id {doc_type}, score double").withColumn("score", F.round("score", PLACES))

    def _in_joins(self, rows: DataFrame, asked: DataFrame, k1: float, b: float) -> DataFrame:
        """For queries of more words than a task may hold."""
        frequency = rows.groupBy("term").agg(F.sum(F.size("doc_ids")).alias("df"))
        held = rows.select("term", F.inline(F.arrays_zip(F.col("doc_ids").alias("doc_id"), F.col("dls").alias("dl"), F.col("tfs").alias("tf"))))
        met = held.join(asked.join(frequency, "term"), "term")
        weight = F.col("qtf") * idf(F.lit(self.n), F.col("df")) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / max(self.mean, 1e-300)))
        return met.groupBy("query_id", "doc_id").agg(F.round(F.sum(weight), PLACES).alias("score"))


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def kept_index(docs: DataFrame, tokens: Column, where: str, doc_id: str = "doc_id", text: str = "text", version: str = "1") -> Index:
    """The index of docs (doc_id, text; rows without an id are not indexed) below the folder ``where``; built if there is
    none of this corpus. ``version`` names the way of cutting words: another one is another index."""
    spark, touched = docs.sparkSession, files_key(docs)
    columns = hashlib.sha256(f"{LAYOUT}|{doc_id}|{text}|{version}|{docs._jdf.queryExecution().optimizedPlan().canonicalized().toString()}".encode()).hexdigest()[:16] if touched else ""
    known = f"{where}/files/{touched}-{columns}" if touched else None
    if known and _exists(spark, known):
        key = spark.read.parquet(known).first()[0]
    else:
        key = f"{fingerprint(docs, doc_id, text)}-{version}-{LAYOUT}"
    path, built = f"{where}/{key}", False
    if not _exists(spark, f"{path}/stats/_SUCCESS"):  # written last, so an index that broke off is built again
        _build(docs, tokens, path, doc_id)
        built = True
    if known:
        spark.createDataFrame([(key,)], "key string").coalesce(1).write.mode("overwrite").parquet(known)
    n, mean = spark.read.parquet(f"{path}/stats").first()
    schema = f"{_schema(docs, doc_id)}, bucket int"
    return Index(spark.read.schema(schema).parquet(f"{path}/postings"), n, mean, key, built)


def _schema(docs: DataFrame, doc_id: str) -> str:
    return f"term string, block bigint, doc_ids array<{docs.schema[doc_id].dataType.simpleString()}>, dls array<int>, tfs array<int>"


def _blocks(cut: DataFrame, schema: str) -> DataFrame:
    """cut: doc_id, t (array of words); rows of an id stand together. Each block's postings, words in order: rows of an id
    that are as long as each other count as one text, as where rows are grouped by id, length and word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = TaskContext.get().partitionId() << 33, [], 0

        def closed() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            ids, lists = rows["doc_id"].combine_chunks(), rows["t"].combine_chunks()
            lengths, coded = pc.list_value_length(lists).to_numpy().astype(np.int64), lists.flatten().dictionary_encode()
            number = ids.dictionary_encode().indices.to_numpy().astype(np.int64)
            text, first, place = np.unique(number << 32 | lengths, return_index=True, return_inverse=True)
            order = pc.array_sort_indices(coded.dictionary).to_numpy().astype(np.int64)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            key, times = np.unique(rank[coded.indices.to_numpy()] * len(text) + np.repeat(place, lengths), return_counts=True)
            ends = pa.array(np.searchsorted(key, np.arange(len(order) + 1) * len(text)).astype(np.int32))
            row = first[key % max(1, len(text))]
            columns = ids.take(pa.array(row)), pa.array(lengths[row].astype(np.int32)), pa.array(times.astype(np.int32))
            terms = coded.dictionary.take(pa.array(order))
            return pa.RecordBatch.from_arrays([terms, pa.array(np.full(len(order), block)), *(pa.ListArray.from_arrays(ends, c) for c in columns)], ["term", "block", "doc_ids", "dls", "tfs"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if size >= BLOCK_WORDS and batch.column(0)[0] != held[-1].column(0)[len(held[-1]) - 1]:
                yield closed()
                block, held, size = block + 1, [], 0
            held.append(batch)
            size += len(batch.column(1).flatten())
        if held:
            yield closed()

    bounded_batches(cut.sparkSession)
    return cut.mapInArrow(run, schema)


def _build(docs: DataFrame, tokens: Column, path: str, doc_id: str) -> None:
    cut = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), tokens.alias("t"))
    met = cut
    if not cut.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():  # ids alone are shuffled to see it
        met = cut.repartition("doc_id").sortWithinPartitions("doc_id")
    # each folder takes files of its own tasks; a word's postings are spread over 8 of them, so no task holds a frequent word whole
    spread = _blocks(met, _schema(docs, doc_id)).withColumn("bucket", bucket_of(F.col("term"))).repartition("bucket", F.pmod(F.xxhash64("block"), F.lit(8)))
    spread.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/postings")
    cut.select(F.size("t").alias("dl")).agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("mean")).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)
