"""Merging sources, conflicts and validation over derived mirrors."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.operators import merging as M
from loomspark.operators import validation as W
from loomspark.plans import fixtures as X

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


_MERGED = f"""WITH {X.CELLS_SQL}, {X.MIRRORS_SQL},
pairs AS (SELECT c.entity_id, c.dim, c.raw AS raw_a, m.raw AS raw_b, source_b FROM cells c JOIN (SELECT *, 'mirror_a' AS source_b FROM mirror_a UNION ALL SELECT *, 'mirror_b' FROM mirror_b) m USING (entity_id, dim) WHERE c.raw <> m.raw),
l AS (SELECT *, raw_a AS raw FROM pairs), {X.coded_sql('l', 'la')}, r AS (SELECT entity_id, dim, raw_a, raw_b, source_b, value AS va, category AS ca, raw_b AS raw FROM la), {X.coded_sql('r', 'lr')},
judged AS (SELECT entity_id, dim, raw_a, raw_b, source_b, va, ca, value AS vb, category AS cb,
  CASE WHEN va IS NOT NULL AND value IS NOT NULL THEN va = value
       WHEN va IS NOT NULL THEN category IN ('EMPTY_SLOT', 'NONE', 'NOT_APPLICABLE')
       WHEN value IS NOT NULL THEN ca IN ('EMPTY_SLOT', 'NONE', 'NOT_APPLICABLE')
       WHEN ca = category THEN true
       WHEN (ca = 'UNKNOWN' AND category = 'EMPTY_SLOT') OR (ca = 'EMPTY_SLOT' AND category = 'UNKNOWN') THEN false
       WHEN ca = 'CONDITIONAL_NO_BASE' OR category = 'CONDITIONAL_NO_BASE' THEN false
       ELSE ca <> 'UNPARSED' AND category <> 'UNPARSED' END AS same
  FROM lr WHERE ca <> 'NOT_APPLICABLE' AND category <> 'NOT_APPLICABLE'),
merged AS (SELECT entity_id, dim, raw_a, raw_b, source_b, CASE WHEN same THEN 'NORMALISED' ELSE 'CONFLICT' END AS event,
  CASE WHEN same THEN NULL WHEN (va IS NULL AND ca <> 'UNKNOWN') OR (vb IS NULL AND cb <> 'UNKNOWN') THEN 'MISSING_IN_ONE' WHEN ca <> cb THEN 'CATEGORY_DIFF' ELSE 'VALUE_MISMATCH' END AS conflict_type FROM judged)"""


def _merged(spark, sf_dir):
    a, b = X.mirrors(spark, sf_dir)
    return M.three_source_merge(X.cells(spark, sf_dir), {"mirror_a": a, "mirror_b": b})


@query(_MERGED + " SELECT * FROM merged")
def three_source_merge(spark, sf_dir):
    return _merged(spark, sf_dir)


@query(_MERGED + " SELECT conflict_type, dim, count(*) AS n FROM merged WHERE event = 'CONFLICT' GROUP BY ALL")
def conflict_classify(spark, sf_dir):
    return _merged(spark, sf_dir).where("event = 'CONFLICT'").groupBy("conflict_type", "dim").agg(F.count("*").alias("n"))


@query(_MERGED + """, c AS (SELECT * FROM merged WHERE event = 'CONFLICT'),
v AS (SELECT entity_id, dim, min(CASE WHEN n >= 2 THEN raw_b END) AS agreed FROM (SELECT entity_id, dim, raw_b, count(DISTINCT source_b) AS n FROM c GROUP BY ALL) GROUP BY ALL),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, dim ORDER BY source_b) AS k FROM c) WHERE k = 1)
SELECT entity_id, dim, conflict_type,
  CASE WHEN conflict_type = 'MISSING_IN_ONE' AND (raw_a IN ('', 'None')) = (raw_b IN ('', 'None')) THEN 'keep_unknown' WHEN conflict_type = 'CATEGORY_DIFF' AND raw_a = '?' THEN 'keep_unknown' ELSE 'prefer_primary' END AS strategy,
  CASE WHEN conflict_type = 'MISSING_IN_ONE' AND raw_a IN ('', 'None') AND raw_b NOT IN ('', 'None') THEN raw_b ELSE raw_a END AS resolved_raw,
  CASE WHEN conflict_type = 'MISSING_IN_ONE' THEN 0.85 WHEN conflict_type = 'CATEGORY_DIFF' AND raw_a = '?' THEN 0.6 WHEN conflict_type = 'CATEGORY_DIFF' THEN 0.75 WHEN agreed IS NOT NULL THEN 0.8 ELSE 0.75 END::DOUBLE AS confidence,
  conflict_type <> 'MISSING_IN_ONE' AS fragile
FROM f JOIN v USING (entity_id, dim)""")
def conflict_resolve(spark, sf_dir):
    """The mirrors are not independent (one copies the other), so their agreement decides nothing."""
    return M.resolve(_merged(spark, sf_dir).where("event = 'CONFLICT'"), ["mirror_a", "mirror_b"], F.lit(False))


@query(f"WITH {X.CELLS_SQL}, {X.MIRRORS_SQL} SELECT count(*) FILTER (a.raw = b.raw) AS same_cells, count(*) FILTER (a.raw <> '' AND b.raw = '') AS only_a, count(*) FILTER (a.raw = '' AND b.raw <> '') AS only_b, 0::BIGINT AS real_diff, true AS b_is_subset, false AS independent FROM mirror_a a JOIN mirror_b b USING (entity_id, dim)")
def mirror_independence(spark, sf_dir):
    return M.mirror_independence(*X.mirrors(spark, sf_dir))


@query(f"""WITH {X.CELLS_SQL}, {X.MIRRORS_SQL}, d AS (SELECT c.dim, position(m.raw IN 'EDCBA') - position(c.raw IN 'EDCBA') AS diff FROM cells c JOIN mirror_a m USING (entity_id, dim) WHERE c.raw IN ('A','B','C','D','E') AND m.raw IN ('A','B','C','D','E')),
s AS (SELECT dim, count(*) FILTER (diff > 0) AS higher, count(*) FILTER (diff < 0) AS lower, count(*) FILTER (diff = 0) AS equal, CAST(sum(diff) AS BIGINT) AS total FROM d GROUP BY dim), t AS (SELECT *, CASE WHEN higher + lower > 0 THEN round(total / (higher + lower), 3) ELSE 0.0 END::DOUBLE AS strength FROM s)
SELECT *, CASE WHEN higher + lower = 0 THEN 'none' WHEN higher + lower < 5 THEN 'too_few' WHEN strength >= 0.8 THEN 'high' WHEN strength <= -0.8 THEN 'low' ELSE 'balanced' END AS verdict FROM t""")
def mirror_bias(spark, sf_dir):
    return M.bias(X.cells(spark, sf_dir), X.mirrors(spark, sf_dir)[0])


@query(f"WITH {X.CODED_SQL}, bad AS (SELECT *, CASE WHEN entity_id % 97 = 0 AND value IS NOT NULL THEN value + 4 ELSE value END AS v2 FROM coded) SELECT 'recomputed_value' AS rule, 'ERROR' AS level, entity_id || '|' || dim AS subject FROM bad WHERE v2 IS DISTINCT FROM value UNION ALL SELECT 'value_in_range', 'ERROR', entity_id || '|' || dim FROM bad WHERE v2 NOT BETWEEN 0 AND 5")
def validate_rules(spark, sf_dir):
    broken = X.coded(spark, sf_dir).withColumn("value", F.when((F.col("entity_id") % 97 == 0) & F.col("value").isNotNull(), F.col("value") + 4).otherwise(F.col("value")))
    return W.violations(broken, F.concat_ws("|", "entity_id", "dim"), W.cell_rules())


@query("SELECT 'unique_name' AS rule, 'ERROR' AS level, p_name AS subject FROM part GROUP BY p_name HAVING count(*) > 1 UNION ALL SELECT 'known_nation', 'ERROR', CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 20)")
def validate_references(spark, sf_dir):
    from loomspark.sources.tables import table

    part, nation = table(spark, sf_dir, "part"), table(spark, sf_dir, "nation").where("n_nationkey < 20")
    return W.all_rules(W.duplicates(part, ["p_name"], "unique_name"), W.dangling(table(spark, sf_dir, "customer"), "c_nationkey", nation, "n_nationkey", "known_nation"))
