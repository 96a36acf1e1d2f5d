"""Changes, checks and judgements: replaced partitions, resolutions with a log, validation, judges, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.parsing import is_noise_heading
from loomspark.functions.text import words
from loomspark.operators import answers as A
from loomspark.operators import audit as U
from loomspark.operators import evaluation as E
from loomspark.operators import validation as V
from loomspark.plans import fixtures as X
from loomspark.plans.structured import _WIDE, wide
from loomspark.sources.tables import dealt, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


@query("WITH fresh AS (SELECT p_brand, p_partkey + 1000000000 AS p_partkey FROM part WHERE p_brand LIKE '%1' AND p_size > 5) SELECT p_brand, p_partkey FROM part WHERE p_brand NOT IN (SELECT p_brand FROM fresh) UNION ALL SELECT * FROM fresh")
def replace_partition(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size")
    fresh = p.where("p_brand like '%1' and p_size > 5").withColumn("p_partkey", F.col("p_partkey") + 1000000000)
    return U.replace_partition(p.drop("p_size"), fresh, "p_brand")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 2 = 0 OR EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49.5 AND l_discount > 0.08)")
def prune_unreferenced(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 49.5 and l_discount > 0.08").select(F.col("l_suppkey").alias("s_suppkey"))
    return U.prune_unreferenced(s, "s_suppkey", s.where("s_suppkey % 2 = 0"), used)


def _applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as conflicts: F is resolved by a human, P by rule; every third order has a resolution."""
    o = table(spark, sf_dir, "orders")
    conflicts = o.select("o_orderkey", F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")).alias("resolved_value"), F.when(F.col("o_orderstatus") == "F", "human").when(F.col("o_orderstatus") == "P", "rule").alias("resolved_by"))
    return U.apply_resolutions(conflicts, o.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("3-MEDIUM").alias("new_value")), "o_orderkey")


_APPLIED = """applied AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' AND o_orderkey % 3 = 0 THEN '3-MEDIUM' WHEN o_orderstatus <> 'O' THEN o_orderpriority END AS value, CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END AS previous,
CASE WHEN o_orderstatus <> 'F' AND o_orderkey % 3 = 0 THEN 'updated' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'kept' END AS action FROM orders)"""


@query(f"WITH {_APPLIED} SELECT * FROM applied")
def apply_resolutions(spark, sf_dir):
    return _applied(spark, sf_dir)


@query(f"WITH {_APPLIED} SELECT o_orderkey, previous AS old_value, value AS new_value FROM applied WHERE action = 'updated' AND value IS DISTINCT FROM previous")
def resolution_log(spark, sf_dir):
    return U.audit_log(_applied(spark, sf_dir), "o_orderkey")


@query(f"WITH {_APPLIED} SELECT 'all' AS status, count(*) AS n FROM applied UNION ALL SELECT 'pending', count(*) FILTER (value IS NULL) FROM applied UNION ALL SELECT 'resolved', count(value) FROM applied")
def status_filter(spark, sf_dir):
    applied = _applied(spark, sf_dir).select("value")
    counts = [U.with_status(applied, s, "value").agg(F.count("*").alias("n")).select(F.lit(s).alias("status"), "n") for s in ("all", "pending", "resolved")]
    return V.all_rules(*counts)


@query("SELECT doc_id FROM documents WHERE list_contains(regexp_extract_all(lower(text), '[a-z0-9]+'), 'time') OR list_has_any(regexp_extract_all(lower(text), '[a-z0-9]+'), ['the', 'der']) ")
def array_membership(spark, sf_dir):
    w = words(F.col("text"))
    return table(spark, sf_dir, "documents").where(F.array_contains(w, "time") | F.arrays_overlap(w, F.array(F.lit("the"), F.lit("der")))).select("doc_id")


_TWICE = f"{X.CELLS_SQL}, {X.MIRRORS_SQL}, twice AS (SELECT entity_id, dim, raw FROM mirror_a UNION ALL SELECT entity_id, dim, raw FROM mirror_b UNION ALL SELECT entity_id, dim, raw FROM cells WHERE entity_id % 10 = 3)"


@query(f"WITH {_TWICE} SELECT entity_id, dim, count(*) AS n, count(DISTINCT raw) AS n_raw, min(raw) AS low, max(raw) AS high, CASE WHEN count(DISTINCT raw) > 1 THEN 'DUPLICATE_IN_SOURCE' ELSE 'EXACT' END AS kind FROM twice GROUP BY ALL HAVING count(*) > 1")
def source_duplicates(spark, sf_dir):
    a, b = X.mirrors(spark, sf_dir)
    once = X.cells(spark, sf_dir).where("entity_id % 10 = 3").select("entity_id", "dim", "raw")
    return U.source_duplicates(a.unionByName(b).unionByName(once), ["entity_id", "dim"], "raw")


@query(f"""WITH {_WIDE}, w AS (SELECT entity_id, v0 + v1 + v2 + v3 + v4 + v5 AS total, CASE WHEN entity_id % 50 = 0 THEN 99 WHEN entity_id % 49 = 0 THEN NULL ELSE v0 + v1 + v2 + v3 + v4 + v5 END AS stated FROM wide)
SELECT 'composite_consistency' AS rule, 'ERROR' AS level, CAST(entity_id AS VARCHAR) AS subject FROM w WHERE stated IS DISTINCT FROM total""")
def composite_consistency(spark, sf_dir):
    """A stated composite must be the sum of the six values, and absent where one is."""
    k = F.col("entity_id")
    stated = wide(spark, sf_dir).withColumn("stated", F.when(k % 50 == 0, 99).when(k % 49 == 0, F.lit(None)).otherwise(F.col("composite")))
    return V.violations(stated, k, {"composite_consistency": ("ERROR", F.col("stated").eqNullSafe(F.col("composite")))})


@query(f"WITH {_TWICE} SELECT 'conflict_recorded' AS rule, 'ERROR' AS level, entity_id || '|' || dim AS subject FROM (SELECT entity_id, dim FROM twice GROUP BY ALL HAVING count(DISTINCT raw) > 1) WHERE entity_id % 20 = 0")
def conflict_recorded(spark, sf_dir):
    """Every disagreement between sources must stand in the table of conflicts, from which some are missing here."""
    found = source_duplicates(spark, sf_dir).where("kind = 'DUPLICATE_IN_SOURCE'").select(F.concat_ws("|", "entity_id", "dim").alias("subject"), "entity_id")
    return V.dangling(found, "subject", found.where("entity_id % 20 <> 0").select(F.col("subject").alias("_recorded")), "_recorded", "conflict_recorded")


@query("""WITH c AS (SELECT doc_id, CASE WHEN doc_id % 40 = 0 THEN NULL ELSE source END AS owner, CASE WHEN doc_id % 33 = 0 THEN left(text, 20) ELSE text END AS content, n_chars FROM documents)
SELECT 'chunk_has_owner' AS rule, 'ERROR' AS level, CAST(doc_id AS VARCHAR) AS subject FROM c WHERE owner IS NULL UNION ALL SELECT 'chunk_long_enough', 'WARN', CAST(doc_id AS VARCHAR) FROM c WHERE length(content) < 80 UNION ALL SELECT 'chunk_length_stated', 'ERROR', CAST(doc_id AS VARCHAR) FROM c WHERE length(content) <> n_chars""")
def chunk_integrity(spark, sf_dir):
    k = F.col("doc_id")
    c = table(spark, sf_dir, "documents").select(k, F.when(k % 40 != 0, F.col("source")).alias("owner"), F.when(k % 33 == 0, F.substring("text", 1, 20)).otherwise(F.col("text")).alias("content"), "n_chars")
    return V.violations(c, k, {"chunk_has_owner": ("ERROR", F.col("owner").isNotNull()), "chunk_long_enough": ("WARN", F.length("content") >= 80), "chunk_length_stated": ("ERROR", F.length("content") == F.col("n_chars"))})


@query("SELECT 'orders' AS name, count(*) AS n, count(DISTINCT o_orderkey) = count(*) AS unique_ids, count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) AS illegal FROM orders UNION ALL SELECT 'customer', count(*), count(DISTINCT c_custkey) = count(*), count(*) FILTER (c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) FROM customer")
def table_checks(spark, sf_dir):
    """Rows, uniqueness of ids, and values out of a closed list, one pass a table."""
    def checked(name, key, column, legal):
        return table(spark, sf_dir, name).agg(F.count("*").alias("n"), F.count_distinct(key).alias("d"), F.count_if(~F.col(column).isin(*legal)).alias("illegal")).select(F.lit(name).alias("name"), "n", (F.col("d") == F.col("n")).alias("unique_ids"), "illegal")

    return checked("orders", "o_orderkey", "o_orderstatus", ("O", "F")).unionByName(checked("customer", "c_custkey", "c_mktsegment", ("BUILDING", "MACHINERY")))


@query(f"WITH {_WIDE} SELECT 'no_values_in_appended' AS rule, 'ERROR' AS level, CAST(entity_id AS VARCHAR) AS subject FROM wide WHERE coalesce(v0, v1, v2, v3, v4, v5) IS NOT NULL AND entity_id % 8 = 0")
def appended_guard(spark, sf_dir):
    """A batch of appended records may carry no values at all, nought included."""
    batch = wide(spark, sf_dir).where("entity_id % 8 = 0")
    return V.violations(batch, F.col("entity_id"), {"no_values_in_appended": ("ERROR", F.coalesce(*(F.col(f"v{d}") for d in range(6))).isNull())})


@query("SELECT user_id, max(epoch_us(ts)) AS last_seen FROM events GROUP BY user_id ORDER BY last_seen DESC, user_id LIMIT 500")
def session_eviction(spark, sf_dir):
    """At most 500 sessions are held, those seen last; the limit is the feature."""
    return U.evicted(table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("s")), "user_id", "s", 500)


@query("""WITH names AS (SELECT DISTINCT s_nationkey AS entity_id, s_name AS name FROM supplier WHERE s_suppkey % 6 = 0 UNION SELECT n_nationkey, n_name FROM nation UNION SELECT n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT entity_id, name FROM names WHERE entity_id IN (SELECT entity_id FROM names GROUP BY entity_id HAVING count(*) <= 3) AND name NOT IN (SELECT r_name FROM region)""")
def name_list_quality(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    names = t("supplier").where("s_suppkey % 6 = 0").select(F.col("s_nationkey").alias("entity_id"), F.col("s_name").alias("name"))
    names = names.unionByName(t("nation").select(F.col("n_nationkey").alias("entity_id"), F.col("n_name").alias("name")))
    names = names.unionByName(t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_regionkey").alias("entity_id"), F.col("r_name").alias("name")))
    return U.name_quality(names, t("region").select(F.col("r_name").alias("name")))


@query("WITH p AS (SELECT n_nationkey AS page, n_regionkey AS name, CASE WHEN n_nationkey % 4 = 3 THEN NULL ELSE coalesce(lead(n_nationkey) OVER w, min(n_nationkey) OVER (PARTITION BY n_regionkey)) END AS other, lag(n_nationkey) OVER w AS before FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)), q AS (SELECT page, name, CASE WHEN page % 2 = 0 THEN other ELSE coalesce(before, other) END AS other FROM p) SELECT a.name, a.page AS low, b.page AS high FROM q a JOIN q b ON a.name = b.name AND a.other = b.page AND b.other = a.page WHERE a.page < b.page")
def hatnote_pairs(spark, sf_dir):
    """Pages of one name that each point at the other."""
    from pyspark.sql import Window

    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    k = F.col("n_nationkey")
    p = table(spark, sf_dir, "nation").select(k.alias("page"), F.col("n_regionkey").alias("name"), F.when(k % 4 != 3, F.coalesce(F.lead(k).over(w), F.min(k).over(Window.partitionBy("n_regionkey")))).alias("next"), F.lag(k).over(w).alias("before"))
    q = p.withColumn("other", F.when(F.col("page") % 2 == 0, F.col("next")).otherwise(F.coalesce("before", "next")))
    return U.mutual(q, "name", "page", "other")


@query("SELECT p_partkey, p_partkey % 3 <> 1 AS verified FROM part")
def candidate_check(spark, sf_dir):
    """A page counts for a name only if it has the name as whole words: a longer word is another one."""
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("About ("), F.upper("p_name"), F.lit("), a part."))).when(k % 3 == 1, F.concat(F.lit("Un"), "p_name", F.lit("ish things"))).otherwise(F.concat(F.lit("the "), F.replace("p_name", F.lit(" "), F.lit("-"))))
    return U.named_in(table(spark, sf_dir, "part").withColumn("text", text), "p_name", "text").select("p_partkey", "verified")


HEADINGS = ("References", "Plot", " See Also ", "Notes on time", "GALLERY", "Powers")


@query("SELECT p_partkey, p_partkey % 6 IN (0, 2, 4) AS noise FROM part")
def noise_filter(spark, sf_dir):
    heading = F.element_at(F.array(*map(F.lit, HEADINGS)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", is_noise_heading(heading).alias("noise"))


_JUDGED = """judged AS (SELECT p_partkey AS query_id, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) || '!' WHEN 1 THEN 'It is "' || p_name || '", of ' || p_brand || ' and ' || repeat('very ', 40) || 'good.' WHEN 2 THEN 'the ' || p_brand ELSE '' END AS answer, p_name, p_brand FROM part),
n AS (SELECT query_id, ' ' || trim(regexp_replace(regexp_replace(lower(answer), '["'']', '', 'g'), '[^a-z0-9]+', ' ', 'g')) || ' ' AS a, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS g1, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) AS g2 FROM judged),
h AS (SELECT *, contains(a, g1)::INT + contains(a, g2)::INT AS hits, length(trim(a)) > 3 * (length(g1) + length(g2)) AS long FROM n)"""


@query(f"WITH {_JUDGED} SELECT query_id, CASE WHEN contains(a, ' ' || g1 || ' ') OR contains(a, ' ' || g2 || ' ') THEN 1.0 ELSE 0.0 END::DOUBLE AS exact, CASE WHEN hits = 0 THEN 0.0::DOUBLE ELSE round(2 * r * p / (r + p), 4) END AS as_set, round(hits / 2.0::DOUBLE, 4) AS contained FROM (SELECT *, hits / 2.0::DOUBLE AS r, CASE WHEN long THEN hits / 2.0::DOUBLE * 0.7 ELSE hits / 2.0::DOUBLE END AS p FROM h)")
def judge_answers(spark, sf_dir):
    """Three judges over answers that are right in other letters, long, half right or empty."""
    return _judged(spark, sf_dir).select("query_id", "exact", "as_set", "contained")


def _judged(spark, sf_dir):
    k = F.col("p_partkey")
    answer = F.when(k % 4 == 0, F.concat(F.upper("p_name"), F.lit("!"))).when(k % 4 == 1, F.concat(F.lit('It is "'), "p_name", F.lit('", of '), "p_brand", F.lit(" and " + "very " * 40 + "good."))).when(k % 4 == 2, F.concat(F.lit("the "), "p_brand")).otherwise("")
    rows = dealt(table(spark, sf_dir, "part")).select(k.alias("query_id"), answer.alias("answer"), F.array("p_name", "p_brand").alias("gold"))
    return rows.select("query_id", E.judge_exact(rows, "answer", "gold").alias("exact"), E.judge_set(rows, "answer", "gold").alias("as_set"), E.judge_contains(rows, "answer", "gold").alias("contained"))


@query(f"WITH {_JUDGED} SELECT CAST(query_id % 4 AS BIGINT) AS kind, count(*) AS n, round(avg(hits / 2.0::DOUBLE), 4) AS mean, count(*) FILTER (hits = 2) AS n_full FROM h GROUP BY ALL")
def judge_summary(spark, sf_dir):
    """Mean by kind of question and how many are wholly right."""
    return _judged(spark, sf_dir).groupBy((F.col("query_id") % 4).alias("kind")).agg(F.count("*").alias("n"), F.round(F.avg("contained"), 4).alias("mean"), F.count_if(F.col("contained") >= 0.999).alias("n_full"))


_W = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))"


@query(f"""WITH t AS (SELECT conv_id, turn, role, {_W} AS w, lag({_W}) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM conversations), s AS (SELECT conv_id, CASE WHEN len(e) > 0 THEN len(list_filter(e, lambda x: list_contains(w, x))) / len(e)::DOUBLE END AS s FROM t WHERE role = 'assistant' AND e IS NOT NULL)
SELECT conv_id AS query_id, count(*) AS n_evidence, round(coalesce(avg(s), 0), 4) AS ratio, count(*) FILTER (s >= 0.2) AS n_used FROM s GROUP BY conv_id""")
def evidence_use(spark, sf_dir):
    """How much of the turn before an answer uses."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations").withColumn("w", words(F.col("text"))).withColumn("e", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))).where("role = 'assistant' and e is not null")
    return U.utilisation(c.select(F.col("conv_id").alias("query_id"), F.col("w").alias("answer_words"), F.col("e").alias("evidence_words")))


MARKERS = ("not known", "cannot say", "no mention")


@query("SELECT p_partkey AS query_id, p_partkey % 4 = 0 AS hedged, p_partkey % 4 = 3 AS is_empty FROM part")
def hedging_flags(spark, sf_dir):
    k = F.col("p_partkey")
    answer = F.when(k % 4 == 0, "That is Not Known.").when(k % 4 == 1, F.concat(F.lit("It is not known to all, but the records tell of "), "p_name")).when(k % 4 == 2, F.col("p_name")).otherwise("  ")
    return table(spark, sf_dir, "part").withColumn("x", A.answer_flags(answer, list(MARKERS))).select(k.alias("query_id"), F.col("x.hedged").alias("hedged"), F.col("x.empty").alias("is_empty"))


@query("""WITH t AS (SELECT n_nationkey AS want, k, lower(left(n_name, k)) AS term FROM nation, (SELECT unnest([2, 3, 4]) AS k)), m AS (SELECT k, want, n_nationkey AS got FROM t JOIN nation ON starts_with(lower(n_name), term))
SELECT CAST(k AS INTEGER) AS min_len, count(*) FILTER (want = got) AS hits, count(*) FILTER (want <> got) AS false_matches FROM m GROUP BY k""")
def fuzzy_thresholds(spark, sf_dir):
    """Right and false matches of name beginnings of 2, 3 and 4 letters: beginnings meet by equality, all lengths in one job."""
    n = table(spark, sf_dir, "nation").withColumn("min_len", F.explode(F.array(*map(F.lit, (2, 3, 4))))).select("min_len", F.lower(F.substring(F.col("n_name"), F.lit(1), F.col("min_len"))).alias("term"), "n_nationkey")
    met = n.join(n.withColumnRenamed("n_nationkey", "got"), ["min_len", "term"])
    return met.groupBy("min_len").agg(F.count_if(F.col("n_nationkey") == F.col("got")).alias("hits"), F.count_if(F.col("n_nationkey") != F.col("got")).alias("false_matches"))


@query("SELECT 'nations' AS metric, CAST(count(*) AS DOUBLE) AS value, 25.0::DOUBLE AS expected, count(*) = 25 AS ok FROM nation UNION ALL SELECT 'regions', count(*), 6.0, count(*) = 6 FROM region UNION ALL SELECT 'moons', NULL, 1.0, false")
def metric_gate(spark, sf_dir):
    """Published numbers against recomputed ones; what differs or is missing is not ok."""
    found = [table(spark, sf_dir, n).agg(F.count("*").cast("double").alias("value")).select(F.lit(m).alias("metric"), "value") for n, m in (("nation", "nations"), ("region", "regions"))]
    return U.gate(V.all_rules(*found), {"nations": 25, "regions": 6, "moons": 1})


@query("""WITH r AS (SELECT l_orderkey AS query_id, l_suppkey AS entity_id, min(l_linenumber) AS f FROM lineitem GROUP BY ALL), k AS (SELECT query_id, entity_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY f, entity_id) AS INTEGER) AS rank FROM r),
g AS (SELECT DISTINCT l_orderkey AS query_id, l_suppkey AS entity_id FROM lineitem WHERE l_quantity > 40) SELECT g.query_id, count(*) AS n_gold, round(count(*) FILTER (rank <= 3) / count(*)::DOUBLE, 4) AS recall_3 FROM g JOIN k USING (query_id, entity_id) GROUP BY g.query_id""")
def entity_recall(spark, sf_dir):
    """Recall of entities when each counts at the first place of its chunks."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("entity_id"), "l_linenumber", "l_quantity")
    gold = l.where("l_quantity > 40").select("query_id", "entity_id").distinct()
    ranks = U.first_seen_ranks(l, "query_id", "l_linenumber", "entity_id")
    return gold.join(ranks, ["query_id", "entity_id"]).groupBy("query_id").agg(F.count("*").alias("n_gold"), F.round(F.count_if(F.col("rank") <= 3) / F.count("*"), 4).alias("recall_3"))
