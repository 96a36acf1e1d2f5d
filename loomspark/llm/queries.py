"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import alignment, byte_bpe, collocations, html_text, media, minhash, mixing, packing, sharding, suffix_dedup, topk, toxicity, wavelet
from loomspark.llm.common import read_table


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(read_table(spark, sf_dir, "pages"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), minhash.Plan(words=4))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


#: Shards of the placement query; every eighth is twice as large.
SHARDS = {f"shard-{i:03d}": 2 if i % 8 == 0 else 1 for i in range(64)}


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(read_table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digests(read_table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.encode_decode(read_table(spark, sf_dir, "documents"))
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read_shards(wavelet.write_shards(read_table(spark, sf_dir, "documents")))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.payload_digests(media.stored_media(read_table(spark, sf_dir, "documents")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digests(read_table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_digests(read_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


OP3_SQL = """
WITH whole AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.row <> c.row
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


#: The level at which the sources that are not stopped share what is left: of all splits by a source's own level, the
#: one that stops just those below the level it gives.
OP11_SQL = r"""
WITH sized AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS words, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS w FROM sized GROUP BY source
), splits AS (
  SELECT -1::DOUBLE AS edge UNION SELECT 3.0 * words / w FROM sources
), levels AS (
  SELECT edge, sum(words)::HUGEINT - sum(CASE WHEN 3.0 * words / w <= edge THEN 3 * words ELSE 0 END) AS left_words, sum(CASE WHEN 3.0 * words / w <= edge THEN 0 ELSE w END)::HUGEINT AS left_weight,
         min(CASE WHEN 3.0 * words / w > edge THEN 3.0 * words / w END) AS next
  FROM splits, sources GROUP BY edge
), level AS (
  SELECT left_words, left_weight FROM levels WHERE left_weight > 0 AND left_words >= 0 AND edge * left_weight <= left_words AND left_words < next * left_weight ORDER BY edge LIMIT 1
), targets AS (
  SELECT source, words, least(3.0 * words, CASE WHEN left_weight > 0 THEN (w * left_words)::DOUBLE / left_weight::DOUBLE ELSE 0 END)::DOUBLE AS target,
         CASE WHEN left_weight > 0 THEN least(3 * words, (w * left_words) // left_weight) ELSE 0 END::BIGINT AS quota
  FROM sources LEFT JOIN level ON true
), placed AS (
  SELECT doc_id, size, words, target, quota,
         coalesce(sum(size) OVER (PARTITION BY t.source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, words AS source_size, target,
       CAST(list_sum(list_transform([0, 1, 2], lambda e: greatest(0, least(place + e * words + size, quota) - place - e * words))) AS BIGINT) AS taken
FROM placed
"""


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')), '[^ 	]+') AS w FROM documents
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang
), grams AS (
  SELECT lang, size, phrase, count(*) AS f FROM (
    SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE len(w) >= size
  ) GROUP BY ALL HAVING count(*) >= 30
), found AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE size > 1
), cuts AS (
  SELECT c.lang, c.phrase, a, k, h.f AS l, t.f AS r, CAST((2000000::HUGEINT * a) // (h.f + t.f) AS BIGINT) AS score
  FROM (SELECT *, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, size)) AS k FROM found)) c
  JOIN grams h ON h.lang = c.lang AND h.phrase = head JOIN grams t ON t.lang = c.lang AND t.phrase = tail
), weakest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), held AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM found WHERE size > 2)) GROUP BY ALL
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
  FROM weakest LEFT JOIN held USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80 * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_topk": OP3_SQL, "op11_mixing": OP11_SQL, "op12_collocations": OP12_SQL}
