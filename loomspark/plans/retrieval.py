"""Chunking, lexical and vector retrieval, fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import chunking as C
from loomspark.operators import lexical as L
from loomspark.operators import vector as V
from loomspark.operators.index import kept_index
from loomspark.sources.storage import shared_dir
from loomspark.sources.tables import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


def _tokens_sql(source: str, key: str) -> str:
    return f"(SELECT {key}, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: len(w) > 1 AND w NOT IN ({_STOP})) AS t FROM {source})"


def _bm25_sql(score: str = "k1 + 1", extra: str = "", settings: str = "(SELECT 0 AS setting, 1.2::DOUBLE AS k1, 0.5::DOUBLE AS b)") -> str:
    return f"""dt AS (SELECT doc_id, t, len(t) AS dl FROM {_tokens_sql('documents', 'doc_id')}),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dt),
po AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, dl, unnest(t) AS term FROM dt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM po GROUP BY term),
qt AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(t) AS term FROM {_tokens_sql('benchmark', 'item_id')}) GROUP BY ALL),
settings AS {settings},
sc AS (SELECT setting, query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))), 6) AS score FROM qt JOIN df USING (term) JOIN po USING (term), st, settings GROUP BY ALL),
bm AS (SELECT setting, query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY setting, query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM sc)"""


@query(f"WITH {_bm25_sql()} SELECT query_id, rank, doc_id, score FROM bm WHERE rank <= 10")
def bm25_search(spark, sf_dir):
    return L.bm25(_items(spark, sf_dir), _docs(spark, sf_dir), "doc_id", T.latin_tokens(F.col("text")), T.latin_tokens(F.col("text")), 10)


@query(f"WITH {_bm25_sql()} SELECT query_id, rank, doc_id, score FROM bm WHERE rank <= 10")
def bm25_indexed(spark, sf_dir):
    """The same from a kept index: the folder of the index is found again while the application lives."""
    tokens = T.latin_tokens(F.col("text"))
    kept = kept_index(table(spark, sf_dir, "documents").select("doc_id", "text"), tokens, f"{shared_dir(spark).rstrip('/')}/lexical-index", version="latin")
    return kept.search(_items(spark, sf_dir), tokens, 10)


@query(f"WITH {_bm25_sql(settings='(SELECT CAST(i AS INTEGER) AS setting, [1.2, 1.5, 2.0][i // 3 + 1]::DOUBLE AS k1, [0.5, 0.75, 1.0][i % 3 + 1]::DOUBLE AS b FROM range(9) x(i))')} SELECT setting, query_id, rank, doc_id, score FROM bm WHERE rank <= 5")
def bm25_param_sweep(spark, sf_dir):
    grid = spark.createDataFrame([(i, k1, b) for i, (k1, b) in enumerate((k1, b) for k1 in (1.2, 1.5, 2.0) for b in (0.5, 0.75, 1.0))], "setting int, k1 double, b double")
    return L.bm25(_items(spark, sf_dir), _docs(spark, sf_dir), "doc_id", T.latin_tokens(F.col("text")), T.latin_tokens(F.col("text")), 5, settings=grid)


@query(f"""WITH {_bm25_sql()}, boosted AS (SELECT query_id, doc_id, round(sum(score), 6) AS score FROM (SELECT query_id, doc_id, score FROM sc UNION ALL SELECT item_id, doc_id, 6.0 FROM benchmark JOIN documents ON doc_id % 100 = item_id) GROUP BY ALL)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM boosted) WHERE rank <= 5""")
def bm25_boost(spark, sf_dir):
    docs, items = _docs(spark, sf_dir), _items(spark, sf_dir)
    linked = docs.select((F.col("doc_id") % 100).alias("query_id"), "doc_id").join(F.broadcast(items.select("query_id")), "query_id")
    return L.bm25(items, docs, "doc_id", T.latin_tokens(F.col("text")), T.latin_tokens(F.col("text")), 5, boosts=linked)


@query(f"WITH {_bm25_sql()} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, st")
def df_idf(spark, sf_dir):
    tokens = T.latin_tokens(F.col("text"))
    frequency = L.postings(_docs(spark, sf_dir), "doc_id", tokens).groupBy("term").agg(F.count("*").alias("df"))
    return frequency.join(F.broadcast(L.corpus_stats(_docs(spark, sf_dir), tokens))).select("term", "df", F.round(L.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query(f"WITH {_bm25_sql()} SELECT term, doc_id, tf, CAST(dl AS INTEGER) AS dl FROM po")
def postings(spark, sf_dir):
    return L.postings(_docs(spark, sf_dir), "doc_id", T.latin_tokens(F.col("text")))


_GRAMS = "(SELECT {key}, unnest(list_transform(range(1, len(p) - 1), lambda i: substring(p, i, 3))) AS g FROM (SELECT {key}, '  ' || lower(trim(regexp_replace(text, '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g'))) || '  ' AS p FROM {source}))"
_GRAM_SQL = f"""gq AS (SELECT item_id AS query_id, g, count(*) AS x FROM {_GRAMS.format(key='item_id', source='benchmark')} GROUP BY ALL), gd AS (SELECT doc_id, g, count(*) AS y FROM {_GRAMS.format(key='doc_id', source='documents')} GROUP BY ALL),
gs AS (SELECT query_id, doc_id, round(sum(x * y) / (qn * dn), 6) AS score FROM gq JOIN gd USING (g) JOIN (SELECT query_id, sqrt(sum(x * x)) AS qn FROM gq GROUP BY ALL) USING (query_id) JOIN (SELECT doc_id, sqrt(sum(y * y)) AS dn FROM gd GROUP BY ALL) USING (doc_id) GROUP BY query_id, doc_id, qn, dn),
gr AS (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM gs)"""


def _gram_ranking(spark, sf_dir, k):
    return V.gram_cosine(_items(spark, sf_dir), _docs(spark, sf_dir), "text", k)


@query(f"WITH {_GRAM_SQL} SELECT query_id, rank, doc_id, score FROM gr WHERE rank <= 5")
def char_ngram_cosine(spark, sf_dir):
    return _gram_ranking(spark, sf_dir, 5)


@query(f"""WITH {_bm25_sql()}, {_GRAM_SQL}, f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (30 + rank)), 8) AS score FROM (SELECT query_id, doc_id, rank FROM bm WHERE rank <= 40 UNION ALL SELECT query_id, doc_id, rank FROM gr WHERE rank <= 40) GROUP BY ALL)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM f) WHERE rank <= 10""")
def hybrid_search(spark, sf_dir):
    tokens = T.latin_tokens(F.col("text"))
    lexical = L.bm25(_items(spark, sf_dir), _docs(spark, sf_dir), "doc_id", tokens, tokens, 40)
    return L.rrf([lexical, _gram_ranking(spark, sf_dir, 40)], 10)


@query(f"""WITH {_bm25_sql()}, c AS (SELECT query_id, doc_id FROM bm WHERE rank <= 20), s AS (SELECT query_id, doc_id, round(len(list_intersect(list_distinct(q.t), d.t)) / len(list_distinct(q.t)), 6) AS score FROM c JOIN {_tokens_sql('benchmark', 'item_id')} q ON q.item_id = query_id JOIN dt d USING (doc_id))
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s) WHERE rank <= 5""")
def rerank_pluggable(spark, sf_dir):
    docs, items = _docs(spark, sf_dir), _items(spark, sf_dir)
    tokens = T.latin_tokens(F.col("text"))
    found = L.bm25(items, docs, "doc_id", tokens, tokens, 20).select("query_id", "doc_id")
    both = docs.join(F.broadcast(found), "doc_id").join(F.broadcast(items.withColumnRenamed("text", "question")), "query_id")
    return L.rerank(both, L.overlap_scorer(T.latin_tokens(F.col("question")), tokens), 5)


@query(f"""WITH {_bm25_sql()}, e AS (SELECT query_id, source, min(rank) AS f FROM bm JOIN documents USING (doc_id) WHERE rank <= 10 GROUP BY ALL) SELECT query_id, source, CAST(row_number() OVER (PARTITION BY query_id ORDER BY f, source) AS INTEGER) AS rank FROM e""")
def entity_rank(spark, sf_dir):
    ranked = bm25_search(spark, sf_dir)
    sources = table(spark, sf_dir, "documents").select("doc_id", "source").join(F.broadcast(ranked), "doc_id")
    return L.first_seen(sources, "source")


@query("""WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, u.vec_id, round(list_sum(list_transform(list_zip(q.v, u.v), lambda p: p[1] * p[2])), 6) AS score FROM u q, u WHERE q.vec_id % 100 = 0)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s) WHERE rank <= 5""")
def cosine_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return V.cosine_top(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), e.select("vec_id", F.col("embedding").alias("v")), 5)


@query(None)
def cosine_topk_all(spark, sf_dir):
    """Every vector asks; ``cosine_topk`` asks for ids divisible by 100. Held against brute force in the tests."""
    return V.cosine_top_all(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v")), 5)


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 5) AS norm, 1.0::DOUBLE AS unit_norm FROM embeddings")
def l2_normalize(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(V.norm(F.col("embedding")), 5).alias("norm"), F.round(V.norm(V.unit(F.col("embedding"))), 5).alias("unit_norm"))


@query("SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, content FROM (SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE length(content) >= 80")
def section_chunks(spark, sf_dir):
    return C.split_chunks(_docs(spark, sf_dir), 80)


@query("SELECT doc_id, CAST(min(pos) - 1 AS INTEGER) AS pos, content FROM (SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) GROUP BY doc_id, content")
def dedupe_chunks(spark, sf_dir):
    return C.keep_first(C.split_chunks(_docs(spark, sf_dir)), "doc_id", "content").select("doc_id", "pos", "content")


_JOINED = """lines AS (SELECT doc_id, pos - 1 AS pos, trim(regexp_replace(content, '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g')) AS c FROM (SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
held AS (SELECT doc_id, pos, c, coalesce(sum(length(c) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low FROM lines WHERE c <> ''),
owners AS (SELECT doc_id, string_agg(c, ' ' ORDER BY pos) AS text FROM held GROUP BY doc_id),
cut AS (SELECT doc_id, w, substring(text, CAST(w * 448 + 1 AS BIGINT), 512) AS content, w * 448 AS start FROM (SELECT doc_id, text, unnest(range(CASE WHEN length(text) <= 512 THEN 1 ELSE (length(text) + 447) // 448 END)) AS w FROM owners))"""


@query(f"WITH {_JOINED} SELECT doc_id, CAST(w AS INTEGER) AS \"window\", content FROM cut WHERE trim(content) <> ''")
def fixed_windows(spark, sf_dir):
    return C.fixed_windows(C.split_chunks(_docs(spark, sf_dir)), "doc_id").select("doc_id", "window", "content")


@query(f"WITH {_JOINED} SELECT doc_id, CAST(w AS INTEGER) AS \"window\", CAST(pos AS INTEGER) AS pos FROM cut JOIN held USING (doc_id) WHERE trim(content) <> '' AND low + length(c) > start AND (CASE WHEN low > 0 THEN low - 1 ELSE 0 END) < start + length(content)")
def window_lineage(spark, sf_dir):
    return C.window_sources(C.split_chunks(_docs(spark, sf_dir)), "doc_id")


@query(None)
def pack_chunks(spark, sf_dir):
    """A fold with resets; held against a plain loop in the tests."""
    return C.pack(C.split_chunks(_docs(spark, sf_dir), 1), "doc_id")


@query("SELECT doc_id, count(*) AS n_lines, CAST(sum(length(c)) AS BIGINT) AS n_chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS c FROM documents) WHERE c <> '' GROUP BY doc_id")
def chunk_report(spark, sf_dir):
    return C.split_chunks(_docs(spark, sf_dir), 1).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("content")).alias("n_chars"))


@query(None)
def clean_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query("SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(text, '([.!?])\\s+([A-Z(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: length(trim(s)) >= 2)) AS INTEGER) AS n_sentences FROM documents")
def sentence_split(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(T.sentences(F.col("text"))).alias("n_sentences"))


@query("""WITH w AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{6,}'))) AS word FROM benchmark), s AS (SELECT item_id AS query_id, doc_id, sum((length(d.text) - length(replace(d.text, word, ''))) // length(word))::BIGINT AS hits, length(d.text) AS n FROM w, documents d WHERE contains(d.text, word) GROUP BY ALL)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, n, doc_id) AS INTEGER) AS rank, doc_id, hits FROM s) WHERE rank <= 3""")
def keyword_snippets(spark, sf_dir):
    """Substring counts of each item's longer words."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0)))).alias("word"))
    return L.substring_top(items, _docs(spark, sf_dir), 3)


# The name under which it took every item before its namesake did.
QUERIES["keyword_snippets_all"], SQL["keyword_snippets_all"] = QUERIES["keyword_snippets"], SQL["keyword_snippets"]
