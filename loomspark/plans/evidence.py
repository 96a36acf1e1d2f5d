"""Evidence behind records, gold extended by probe, evidence of others, and the four settings of an answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions.text import squeeze
from loomspark.operators import chunking as C
from loomspark.operators import evidence as E
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


_SQUEEZED = r"trim(regexp_replace({}, '[ \t\r\n\f\x0B]+', ' ', 'g'))"
_CHUNKS = f"""lines AS (SELECT doc_id, source, lang, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS content FROM (SELECT doc_id, source, lang, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
chunks AS (SELECT doc_id * 100000 + pos AS chunk_id, source || lang AS owner, CASE WHEN pos % 6 = 0 THEN 'S' || (doc_id % 40) END AS section, content FROM lines WHERE length(content) >= 80)"""


def _chunks(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    lines = C.split_chunks(docs.select(F.struct("doc_id", "source", "lang").alias("doc_id"), "text"), 80).select("doc_id.*", "pos", "content")
    return lines.select((F.col("doc_id") * 100000 + F.col("pos")).alias("chunk_id"), F.concat("source", "lang").alias("owner"), F.when(F.col("pos") % 6 == 0, F.concat(F.lit("S"), (F.col("doc_id") % 40).cast("string"))).alias("section"), "content")


@query(f"""WITH {_CHUNKS}, records AS (SELECT doc_id AS record_id, source || lang AS owner, 'S' || (doc_id % 80) AS section, substring(text, CAST(doc_id % 90 + 1 AS BIGINT), CAST(10 + doc_id % 70 AS BIGINT)) AS text FROM documents),
same AS (SELECT owner, section, min(chunk_id) AS c FROM chunks WHERE section IS NOT NULL GROUP BY ALL),
asked AS (SELECT record_id, r.owner, same.c AS by_section, substring({_SQUEEZED.format("coalesce(r.text, '')")}, 1, 60) AS probe FROM records r LEFT JOIN same ON same.owner = r.owner AND same.section = r.section),
met AS (SELECT record_id, min(chunk_id) AS by_text FROM asked a JOIN chunks c ON c.owner = a.owner AND contains({_SQUEEZED.format('c.content')}, a.probe) WHERE by_section IS NULL AND length(probe) >= 20 GROUP BY record_id)
SELECT record_id, coalesce(by_section, by_text) AS chunk_id, CASE WHEN by_section IS NOT NULL THEN 'section' WHEN by_text IS NOT NULL THEN 'text' END AS found_by FROM asked LEFT JOIN met USING (record_id)""")
def evidence_lookup(spark, sf_dir):
    """A record for each document: 10 to 79 characters of its text, and a section that its owner's chunks may have."""
    docs = spread(table(spark, sf_dir, "documents"))
    records = docs.select(F.col("doc_id").alias("record_id"), F.concat("source", "lang").alias("owner"), F.concat(F.lit("S"), (F.col("doc_id") % 80).cast("string")).alias("section"), F.expr("substring(text, cast(doc_id % 90 + 1 as int), cast(10 + doc_id % 70 as int))").alias("text"))
    return E.evidence_chunks(records, _chunks(spark, sf_dir))


@query(f"""WITH texts AS (SELECT doc_id AS text_id, lower({_SQUEEZED.format("coalesce(text, '')")}) AS t FROM documents), items AS (SELECT item_id, lower({_SQUEEZED.format('text')}) AS answer FROM benchmark), n AS (SELECT unnest([60, 40, 20]) AS n_probe),
found AS (SELECT n_probe, item_id, text_id, 0 AS g FROM n, items JOIN texts ON contains(t, substring(answer, 1, n_probe)) WHERE length(substring(answer, 1, n_probe)) >= 16),
given AS (SELECT n_probe, item_id, doc_id AS text_id, 1 AS g FROM n, benchmark JOIN documents ON doc_id % 100 = item_id)
SELECT CAST(n_probe AS INTEGER) AS n_probe, item_id, text_id, max(g) = 1 AS given FROM (FROM found UNION ALL FROM given) GROUP BY ALL""")
def gold_extension(spark, sf_dir):
    """Documents that hold the beginning of an item's text, beside gold that is given by number."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.lower(squeeze(F.col("text"))).alias("answer"))
    docs = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("text_id"), "text")
    gold = docs.select((F.col("text_id") % 100).alias("item_id"), "text_id").join(items.select("item_id"), "item_id")
    return E.gold_by_probe(items, docs, gold, F.lower(squeeze(F.col("text"))))


_PIECES = """pieces AS (SELECT doc_id, source, CAST(k AS INTEGER) AS k, substring(text, CAST(k * 40 + 1 AS BIGINT), 40) AS piece FROM (SELECT *, unnest(range(1 + doc_id % 3)) AS k FROM documents WHERE doc_id % 7 <> 0)),
numbered AS (SELECT *, row_number() OVER (ORDER BY source, doc_id, k) - 1 AS n FROM pieces),
owners AS (SELECT source, count(*) AS m, max(count(*)) OVER () AS most, sum(count(*)) OVER () AS total FROM numbered GROUP BY source),
stood AS (SELECT a.*, CAST((a.n + most) % total AS BIGINT) AS stands_in FROM numbered a JOIN owners USING (source))"""


def _pieces(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents")).where("doc_id % 7 <> 0")
    return docs.withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int")))).select("doc_id", "source", "k", F.expr("substring(text, k * 40 + 1, 40)").alias("piece"))


@query(f"WITH {_PIECES} SELECT a.doc_id, a.k, a.n, a.stands_in, a.source = b.source AS own FROM stood a JOIN numbered b ON b.n = a.stands_in")
def counterfactual_evidence(spark, sf_dir):
    rows = E.others_evidence(_pieces(spark, sf_dir), "doc_id", "source", ["k"])
    other = rows.select(F.col("n").alias("stands_in"), F.col("source").alias("_s"))
    return rows.join(other, "stands_in").select("doc_id", "k", "n", "stands_in", (F.col("source") == F.col("_s")).alias("own"))


@query(f"""WITH {_PIECES}, held AS (SELECT a.doc_id, count(*) AS n_pieces, string_agg(coalesce(a.piece, ''), chr(10) ORDER BY a.n) AS own, string_agg('', chr(10) ORDER BY a.n) AS blank, string_agg(coalesce(b.piece, ''), chr(10) ORDER BY a.n) AS other FROM stood a JOIN numbered b ON b.n = a.stands_in GROUP BY a.doc_id),
settings AS (SELECT unnest(['A', 'B', 'C', 'D']) AS setting)
SELECT doc_id, setting, coalesce(n_pieces, 0) AS n_pieces, coalesce(CASE setting WHEN 'C' THEN blank WHEN 'D' THEN other ELSE own END, '') AS evidence FROM settings, documents LEFT JOIN held USING (doc_id)""")
def four_settings(spark, sf_dir):
    items = table(spark, sf_dir, "documents").select("doc_id")
    return E.four_settings(items, _pieces(spark, sf_dir), "doc_id", "source", ["k"], "piece")
