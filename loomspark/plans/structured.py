"""Structured answers: lookups, tops, extremes, lists, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import encoding
from loomspark.operators import relational as R
from loomspark.operators import vector as V
from loomspark.plans import fixtures as X
from loomspark.sources.tables import small, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each entity: its six values, composite and number of missing ones."""
    grouped = X.coded(spark, sf_dir).groupBy("entity_id", "name", "brand").agg(*(F.max(F.when(F.col("dim") == d, F.col("value"))).alias(f"v{d}") for d in range(6)))
    values = [F.col(f"v{d}") for d in range(6)]
    return grouped.withColumn("composite", encoding.composite(*values)).withColumn("missing_count", encoding.missing_count(*values))


_WIDE = X.CODED_SQL + ", wide AS (SELECT entity_id, name, brand, " + ", ".join(f"max(CASE WHEN dim = {d} THEN value END) AS v{d}" for d in range(6)) + " FROM coded GROUP BY ALL)"


@query(f"WITH {X.CODED_SQL} SELECT entity_id, dim, raw, value, category, note FROM coded")
def encode_literals(spark, sf_dir):
    return X.coded(spark, sf_dir).select("entity_id", "dim", "raw", "value", "category", "note")


@query(f"WITH {_WIDE} SELECT entity_id, v0 + v1 + v2 + v3 + v4 + v5 AS composite, CAST((v0 IS NULL)::INT + (v1 IS NULL)::INT + (v2 IS NULL)::INT + (v3 IS NULL)::INT + (v4 IS NULL)::INT + (v5 IS NULL)::INT AS INTEGER) AS missing_count FROM wide")
def composite_null_rule(spark, sf_dir):
    return wide(spark, sf_dir).select("entity_id", "composite", "missing_count")


@query(f"WITH {X.CODED_SQL} SELECT entity_id, dim, raw, value, category, CASE WHEN category = 'INFINITE' THEN '∞' WHEN value = 0 THEN 'none' WHEN value BETWEEN 1 AND 5 THEN substring('EDCBA', value, 1) END AS label, note FROM coded WHERE entity_id = 42 ORDER BY dim")
def fact_lookup(spark, sf_dir):
    return X.coded(spark, sf_dir).where("entity_id = 42").select("entity_id", "dim", "raw", "value", "category", encoding.level_label(F.col("value"), F.col("category")).alias("label"), "note")


@query(f"WITH {X.CODED_SQL} SELECT entity_id, name, category, value FROM coded WHERE dim = 0 AND (category = 'INFINITE' OR value IS NOT NULL) ORDER BY (category = 'INFINITE') DESC, value DESC NULLS LAST, name, entity_id LIMIT 5")
def extreme_top_offscale(spark, sf_dir):
    rows = X.coded(spark, sf_dir).where("dim = 0")
    ordered = rows.where((F.col("category") == "INFINITE") | F.col("value").isNotNull()).orderBy((F.col("category") == "INFINITE").desc(), F.col("value").desc_nulls_last(), "name", "entity_id")
    return ordered.limit(5).select("entity_id", "name", "category", "value")


@query(f"WITH {X.CODED_SQL}, k AS (SELECT *, CASE WHEN category = 'INFINITE' THEN 1e9 ELSE value END AS key FROM coded WHERE dim = 1) SELECT entity_id, category, value FROM k WHERE key = (SELECT max(key) FROM k)")
def extreme_highest_ties(spark, sf_dir):
    return R.extremes(X.coded(spark, sf_dir).where("dim = 1"), "category", "value").select("entity_id", "category", "value")


@query(f"WITH {X.CODED_SQL}, k AS (SELECT * FROM coded WHERE dim = 1 AND category <> 'INFINITE') SELECT entity_id, category, value FROM k WHERE value = (SELECT min(value) FROM k)")
def extreme_lowest_ties(spark, sf_dir):
    return R.extremes(X.coded(spark, sf_dir).where("dim = 1"), "category", "value", highest=False).select("entity_id", "category", "value")


@query(f"WITH {X.CODED_SQL} SELECT value AS level, count(*) AS n, list_sort(list(entity_id)) AS members FROM coded WHERE dim = 2 AND value IS NOT NULL GROUP BY value")
def count_by_level(spark, sf_dir):
    rows = X.coded(spark, sf_dir).where("dim = 2 and value is not null")
    return rows.groupBy(F.col("value").alias("level")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("entity_id")).alias("members"))


@query(f"WITH {X.CODED_SQL} SELECT a.entity_id FROM coded a JOIN coded b USING (entity_id) WHERE a.dim = 0 AND b.dim = 1 AND a.value >= 4 AND b.value >= 3")
def dual_filter(spark, sf_dir):
    return wide(spark, sf_dir).where("v0 >= 4 and v1 >= 3").select("entity_id")


@query(f"WITH {_WIDE} SELECT brand, count(*) AS n, count(v0 + v1 + v2 + v3 + v4 + v5) AS n_complete, round(avg(v0), 2) AS avg_0, round(avg(v1), 2) AS avg_1 FROM wide GROUP BY brand")
def part_stats(spark, sf_dir):
    return wide(spark, sf_dir).groupBy("brand").agg(F.count("*").alias("n"), F.count("composite").alias("n_complete"), F.round(F.avg("v0"), 2).alias("avg_0"), F.round(F.avg("v1"), 2).alias("avg_1"))


@query("SELECT p_type AS kind, count(*) AS n, count(DISTINCT p_brand) AS n_brands, count(*) FILTER (WHERE p_size > 25) AS n_large, max(p_name) AS any_name FROM part GROUP BY p_type")
def distribution(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("n_brands"), F.count_if(F.col("p_size") > 25).alias("n_large"), F.max("p_name").alias("any_name"))


@query("SELECT p_name, count(*) AS n, min(p_partkey) AS first_key FROM part GROUP BY p_name HAVING count(*) > 1")
def having_multi(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_name").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_key")).where("n > 1")


@query("SELECT p_name, p_partkey, CAST(row_number() OVER w AS INTEGER) AS position, lag(p_partkey) OVER w AS parent, count(*) OVER (PARTITION BY p_name) AS n_members FROM part WINDOW w AS (PARTITION BY p_name ORDER BY p_partkey)")
def form_chain(spark, sf_dir):
    from loomspark.operators.linking import chain

    return chain(table(spark, sf_dir, "part").select("p_name", "p_partkey"), "p_name", "p_partkey")


@query("SELECT c_custkey, c_name, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def overview_left_join(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    return t("customer").join(small(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(small(t("region")), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("c_custkey", "c_name", "n_name", "r_name")


@query("SELECT n_name, list_sort(list(s_suppkey)) AS owned, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def owner_reverse(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(small(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.groupBy("n_name").agg(F.array_sort(F.collect_list("s_suppkey")).alias("owned"), F.count("*").alias("n"))


@query("SELECT r_name, n_name, count(c_custkey) AS n_customers FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def hierarchy_contains(spark, sf_dir):
    n = small(table(spark, sf_dir, "nation")).join(small(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    counted = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("c_custkey").alias("n_customers"))
    return n.join(counted, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("r_name", "n_name", F.coalesce("n_customers", F.lit(0)).alias("n_customers"))


@query("SELECT c_custkey, o.o_orderkey AS last_order, o.o_orderstatus AS status FROM customer LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS n FROM orders) WHERE n = 1) o ON o.o_custkey = c_custkey")
def latest_per_key_left_join(spark, sf_dir):
    last = R.latest(table(spark, sf_dir, "orders"), ["o_custkey"], F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey").desc())
    return table(spark, sf_dir, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("o_orderkey").alias("last_order"), F.col("o_orderstatus").alias("status"))


@query("SELECT user_id, event_type AS kind, min(event_id) AS first_event, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY ALL")
def first_per_kind(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type <> 'error'").groupBy("user_id", F.col("event_type").alias("kind")).agg(F.min("event_id").alias("first_event"), F.count("*").alias("n"))


@query(f"WITH {X.POINTS_SQL}, {X.INTERVALS_SQL} SELECT event_id, span_id FROM points p JOIN spans s ON p.grp = s.grp AND p.pos BETWEEN s.low AND s.high")
def range_join(spark, sf_dir):
    return R.range_join(X.points(spark, sf_dir), X.intervals(spark), "grp", "pos", "low", "high", 32).select("event_id", "span_id")


@query(f"WITH {X.POINTS_SQL}, {X.INTERVALS_SQL} SELECT span_id, user_id, min(pos) AS first_at, arg_min(event_id, row(pos, event_id)) AS first_event, count(DISTINCT event_id) AS n FROM points p JOIN spans s ON p.grp = s.grp AND p.pos BETWEEN s.low AND s.high GROUP BY ALL")
def earliest_in_range(spark, sf_dir):
    met = R.range_join(X.points(spark, sf_dir), X.intervals(spark), "grp", "pos", "low", "high", 32)
    return met.groupBy("span_id", "user_id").agg(F.min("pos").alias("first_at"), F.min_by("event_id", F.struct("pos", "event_id")).alias("first_event"), F.count_distinct("event_id").alias("n"))


@query(f"WITH {X.CODED_SQL}, a AS (SELECT dim, value AS a FROM coded WHERE entity_id = 1), b AS (SELECT dim, value AS b FROM coded WHERE entity_id = 14), m AS (SELECT count(*) AS n_common, count(*) FILTER (a > b) AS left_wins, count(*) FILTER (a < b) AS right_wins FROM a JOIN b USING (dim) WHERE a IS NOT NULL AND b IS NOT NULL) SELECT *, CASE WHEN n_common < 3 THEN 'too_few' WHEN left_wins > right_wins THEN 'left' WHEN left_wins < right_wins THEN 'right' ELSE 'even' END AS verdict FROM m")
def compare_pair(spark, sf_dir):
    return R.compare_pair(X.coded(spark, sf_dir), "entity_id", 1, 14)


@query(f"""WITH {X.CODED_SQL}, m AS (SELECT dim, value AS t FROM coded WHERE entity_id = 11 AND value IS NOT NULL), s AS (
SELECT c.entity_id, CAST(count(*) AS INTEGER) AS n_common, sum(CASE WHEN dim <= 1 THEN 1.2::DOUBLE WHEN dim = 5 THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END * (value - t) * (value - t)) AS s FROM coded c JOIN m USING (dim) WHERE c.entity_id <> 11 AND value IS NOT NULL GROUP BY c.entity_id HAVING count(*) >= 3)
SELECT entity_id, n_common, round(sqrt(s) / sqrt(n_common), 2) AS distance FROM s ORDER BY distance, n_common DESC, entity_id LIMIT 10""")
def six_dim_similarity(spark, sf_dir):
    return V.dimension_similarity(X.coded(spark, sf_dir).select("entity_id", "dim", "value"), 11, 10)


@query(f"WITH {X.CODED_SQL} SELECT 'category' AS kind, category AS item, count(*) AS n FROM coded GROUP BY category UNION ALL SELECT 'dim', CAST(dim AS VARCHAR), count(*) FROM coded WHERE value IS NULL GROUP BY dim")
def data_quality_union(spark, sf_dir):
    c = X.coded(spark, sf_dir)
    a = c.groupBy(F.col("category").alias("item")).agg(F.count("*").alias("n")).select(F.lit("category").alias("kind"), "item", "n")
    return a.unionByName(c.where("value is null").groupBy(F.col("dim").cast("string").alias("item")).agg(F.count("*").alias("n")).select(F.lit("dim").alias("kind"), "item", "n"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE lower(o_orderpriority) LIKE '%urgent%' AND o_orderstatus IN ('O', 'F') AND o_totalprice BETWEEN 1000 AND 200000")
def predicate_mix(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.where(F.lower("o_orderpriority").contains("urgent") & F.col("o_orderstatus").isin("O", "F") & F.col("o_totalprice").between(1000, 200000)).select("o_orderkey", "o_orderpriority")


@query("SELECT * FROM (SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_quantity > 49) a WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = a.l_orderkey AND o.o_orderstatus = 'F')")
def anti_join(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").where("l_quantity > 49").select("l_orderkey", "l_linenumber", "l_returnflag").join(done, "l_orderkey", "left_anti")


@query("SELECT p_brand, count(*) AS n, min(p_partkey) AS lowest FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09) GROUP BY p_brand")
def semi_join(spark, sf_dir):
    wanted = table(spark, sf_dir, "lineitem").where("l_discount > 0.09").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").join(wanted, "p_partkey", "left_semi").groupBy("p_brand").agg(F.count("*").alias("n"), F.min("p_partkey").alias("lowest"))


@query("""WITH c AS (SELECT lang, length(text) AS v FROM documents), o AS (SELECT lang, v, row_number() OVER (PARTITION BY lang ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM c)
SELECT lang, max(n) AS n, max(CASE WHEN i = least(CAST(floor(n * 0.5) AS BIGINT), n - 1) THEN v END)::INTEGER AS p50, max(CASE WHEN i = least(CAST(floor(n * 0.9) AS BIGINT), n - 1) THEN v END)::INTEGER AS p90 FROM o GROUP BY lang""")
def nearest_rank_percentiles(spark, sf_dir):
    return R.nearest_rank(table(spark, sf_dir, "documents").select("lang", F.length("text").alias("v")), ["lang"], "v", {"p50": 0.5, "p90": 0.9})


@query("SELECT p_partkey, p_retailprice, CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE 'old' END AS origin FROM part UNION ALL SELECT p_partkey + 1000000000, p_retailprice, 'new' FROM part WHERE p_partkey % 3 = 0")
def upsert_latest(spark, sf_dir):
    old = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", F.lit("old").alias("origin"))
    new = old.where("p_partkey % 3 = 0").withColumn("origin", F.lit("new"))
    return R.upsert(old, new.unionByName(new.withColumn("p_partkey", F.col("p_partkey") + 1000000000)), ["p_partkey"])


@query("SELECT p_partkey, 'old' AS origin FROM part UNION ALL SELECT p_partkey + 1000000000, 'new' FROM part WHERE p_partkey % 3 = 0")
def insert_if_absent(spark, sf_dir):
    old = table(spark, sf_dir, "part").select("p_partkey", F.lit("old").alias("origin"))
    new = old.where("p_partkey % 3 = 0").withColumn("origin", F.lit("new"))
    return R.insert_if_absent(old, new.unionByName(new.withColumn("p_partkey", F.col("p_partkey") + 1000000000)), ["p_partkey"])


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, left(sha1(p_name), 8) AS hash_id FROM part")
def slug_ids(spark, sf_dir):
    from loomspark.functions.text import slug

    return table(spark, sf_dir, "part").select("p_partkey", slug(F.col("p_name")).alias("slug"), F.substring(F.sha1("p_name"), 1, 8).alias("hash_id"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
