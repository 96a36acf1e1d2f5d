"""Record fields, audits, set operations and generated evaluation items."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import records as N
from loomspark.operators import evaluation as E
from loomspark.operators import routing as Q
from loomspark.plans import fixtures as X
from loomspark.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


@query("SELECT a.p_partkey AS entity_id, min(b.p_partkey) AS first_same, count(*) AS n_same FROM part a JOIN part b ON array_to_string(list_sort(string_split(lower(a.p_name), ' ')), ' ') = array_to_string(list_sort(string_split(lower(b.p_name), ' ')), ' ') GROUP BY ALL")
def name_key_join(spark, sf_dir):
    """Counted once for each key, not paired."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), N.sorted_name_key(F.col("p_name")).alias("k"))
    return p.join(p.groupBy("k").agg(F.min("entity_id").alias("first_same"), F.count("*").alias("n_same")), "k").select("entity_id", "first_same", "n_same")


@query("SELECT p_partkey AS entity_id, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS name_key, unnest(string_split(p_name, ' ')) AS word FROM part")
def split_multi_values(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), N.name_key(F.col("p_name")).alias("name_key"), F.explode(F.split("p_name", " ")).alias("word"))


@query("SELECT event_id, part, relative, CASE part WHEN 1 THEN relative WHEN 2 THEN relative + 44 WHEN 3 THEN relative + 113 WHEN 4 THEN relative + 265 WHEN 5 THEN relative + 439 END AS absolute FROM (SELECT event_id, event_id % 7 AS part, event_id % 40 + 1 AS relative FROM events)")
def chapter_normalise(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 7).alias("part"), (F.col("event_id") % 40 + 1).alias("relative"))
    return e.withColumn("absolute", N.absolute_chapter(F.col("part"), F.col("relative")))


@query("SELECT chapter, part, count(*) AS n FROM (SELECT event_id % 800 AS chapter, CASE WHEN event_id % 800 BETWEEN 1 AND 44 THEN 1 WHEN event_id % 800 BETWEEN 45 AND 113 THEN 2 WHEN event_id % 800 BETWEEN 114 AND 265 THEN 3 WHEN event_id % 800 BETWEEN 266 AND 439 THEN 4 WHEN event_id % 800 BETWEEN 440 AND 594 THEN 5 WHEN event_id % 800 BETWEEN 595 AND 752 THEN 6 END AS part FROM events) GROUP BY ALL")
def part_of_chapter(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 800).alias("chapter"))
    return e.withColumn("part", N.part_of_chapter(F.col("chapter"))).groupBy("chapter", "part").agg(F.count("*").alias("n"))


@query("SELECT event_id, kind, CASE WHEN kind <> 'anime' THEN CAST(event_id % 90 AS INTEGER) END AS chapter, CASE WHEN kind = 'anime' THEN CAST(event_id % 90 AS VARCHAR) END AS episode FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'manga' WHEN 1 THEN 'anime' ELSE 'cover' END AS kind FROM events)")
def parse_appearance(spark, sf_dir):
    n = (F.col("event_id") % 90).cast("string")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Chapter "), n, F.lit(": Night"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Golden Episode "), n, F.lit(": Day"))).otherwise(F.concat(F.lit("Chapter "), n, F.lit(" Cover")))
    return table(spark, sf_dir, "events").select("event_id", N.appearance(text).alias("x")).select("event_id", "x.kind", "x.chapter", "x.episode")


@query(f"WITH {X.CELLS_SQL}, {X.MIRRORS_SQL} SELECT dim, position(m.raw IN 'EDCBA') - position(c.raw IN 'EDCBA') AS diff, count(*) AS n FROM cells c JOIN mirror_a m USING (entity_id, dim) WHERE c.raw IN ('A','B','C','D','E') AND m.raw IN ('A','B','C','D','E') GROUP BY ALL")
def value_diff_histogram(spark, sf_dir):
    from loomspark.functions.encoding import GRADES, grade_value

    a, b = X.cells(spark, sf_dir).where(F.col("raw").isin(*GRADES)).select("entity_id", "dim", grade_value(F.col("raw")).alias("x")), X.mirrors(spark, sf_dir)[0].where(F.col("raw").isin(*GRADES)).select("entity_id", "dim", grade_value(F.col("raw")).alias("y"))
    return a.join(b, ["entity_id", "dim"]).groupBy("dim", (F.col("y") - F.col("x")).cast("long").alias("diff")).agg(F.count("*").alias("n"))


@query("SELECT p_brand, n, round((n - lo_n) / (hi_n - lo_n)::DOUBLE, 4) AS n_scaled, price, round((price - lo_p) / (hi_p - lo_p), 4) AS price_scaled FROM (SELECT *, min(n) OVER () AS lo_n, max(n) OVER () AS hi_n, min(price) OVER () AS lo_p, max(price) OVER () AS hi_p FROM (SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 2) AS price FROM part GROUP BY p_brand))")
def sweep_scoring(spark, sf_dir):
    stats = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 2).alias("price"))
    return E.min_max(stats, ["n", "price"])


@query("WITH t AS (SELECT lower(p_name) AS alias, min(p_partkey) AS owner FROM part GROUP BY ALL) SELECT CASE WHEN owner = p_partkey THEN 'resolved' ELSE 'misresolved' END AS outcome, count(*) AS n FROM part JOIN t ON alias = lower(p_name) GROUP BY ALL")
def coverage_audit(spark, sf_dir):
    from loomspark.operators.linking import alias_table

    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.lower("p_name").alias("alias"))
    owners = alias_table(p.withColumn("priority", F.lit(0))).select("alias", F.col("entity_id").alias("owner"))
    outcome = F.when(F.col("owner").isNull(), "unresolved").when(F.col("owner") == F.col("entity_id"), "resolved").otherwise("misresolved")
    return p.join(owners, "alias", "left").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS entity_id, p_name || ' is a part of ' || p_brand || ' in size ' || p_size || '.' AS sentence FROM part UNION ALL SELECT p_partkey, p_name || ' is made as ' || p_type || '.' FROM part")
def synthetic_corpus(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    said = F.array(F.format_string("%s is a part of %s in size %d.", "p_name", "p_brand", "p_size"), F.format_string("%s is made as %s.", "p_name", "p_type"))
    return p.select(F.col("p_partkey").alias("entity_id"), F.explode(said).alias("sentence"))


@query("SELECT page_id, CASE WHEN regexp_matches(head, '<article') THEN 'article' ELSE 'other' END AS kind, CASE WHEN regexp_matches(lower(url), '\\.(gif)$') THEN 'noise' WHEN contains(url, '?') THEN 'query' ELSE 'plain' END AS url_kind FROM (SELECT page_id, url, left(html, 3000) AS head FROM pages)")
def page_kinds(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.when(F.substring("html", 1, 3000).rlike("<article"), "article").otherwise("other").alias("kind"), F.when(F.lower("url").rlike(r"\.gif$"), "noise").when(F.contains("url", F.lit("?")), "query").otherwise("plain").alias("url_kind"))


@query("SELECT 'part' AS name, count(*) AS n FROM part UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'documents', count(*) FROM documents")
def counts_manifest(spark, sf_dir):
    out = None
    for name in ("part", "orders", "documents"):
        row = table(spark, sf_dir, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("(SELECT s_nationkey AS nation FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 0) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def set_operations(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_nationkey").alias("nation"))
    return s.intersect(c).subtract(table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("nation")))


@query("SELECT p_partkey AS query_id, 'brand' AS kind, 'Which brand makes part ' || p_partkey || '?' AS question, p_brand AS answer, 'structured' AS route_expect FROM part UNION ALL SELECT p_partkey, 'size', 'What is the size of part ' || p_partkey || '?', CAST(p_size AS VARCHAR), 'structured' FROM part")
def eval_set(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    items = F.array(
        F.struct(F.lit("brand").alias("kind"), F.format_string("Which brand makes part %d?", "p_partkey").alias("question"), F.col("p_brand").alias("answer")),
        F.struct(F.lit("size").alias("kind"), F.format_string("What is the size of part %d?", "p_partkey").alias("question"), F.col("p_size").cast("string").alias("answer")),
    )
    return p.select(F.col("p_partkey").alias("query_id"), F.explode(items).alias("x")).select("query_id", "x.kind", "x.question", "x.answer", F.lit("structured").alias("route_expect"))


@query(f"WITH r AS ({Q.ROUTE_SQL}) SELECT count(*) AS n, count(*) FILTER (route = 'abstain') AS abstained, round(avg(CASE WHEN query_id % 8 = 7 THEN (route = 'abstain')::INT END), 4) AS abstain_rate, round(avg(CASE WHEN query_id % 8 <> 7 THEN (route = 'abstain')::INT END), 4) AS false_abstain_rate FROM r")
def abstain_metrics(spark, sf_dir):
    must, did = F.col("query_id") % 8 == 7, (F.col("route") == "abstain")
    return Q.route(Q.questions(spark, sf_dir)).agg(F.count("*").alias("n"), F.count_if(did).alias("abstained"), F.round(F.avg(F.when(must, did.cast("int"))), 4).alias("abstain_rate"), F.round(F.avg(F.when(~must, did.cast("int"))), 4).alias("false_abstain_rate"))


@query("SELECT o_orderpriority AS priority, avg((o_orderstatus = 'F')::INT) AS share_f, max(o_totalprice) AS top FROM orders GROUP BY ALL")
def hypothesis_share(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("share_f"), F.max("o_totalprice").alias("top"))
