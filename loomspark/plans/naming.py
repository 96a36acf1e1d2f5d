"""Names out of contradicting sources, and parts of names met in texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions.text import words
from loomspark.operators import linking as L
from loomspark.operators import names as N
from loomspark.sources.tables import dealt, spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_DIGITS, _HAN = "0123456789", "零一二三四五六七八九"
# A part's names: forced for every ninth, official for every second, fetched and added ones; short ones and other forms among them.
_GIVEN = f"""given AS (
  SELECT entity_id, source, place, translate(CAST(code AS VARCHAR), '{_DIGITS}', '{_HAN}') || tail AS name FROM (
    SELECT p_partkey AS entity_id, 'forced' AS source, 0 AS place, p_partkey % 310 AS code, '王' AS tail FROM part WHERE p_partkey % 9 = 0
    UNION ALL SELECT p_partkey, 'official', 0, p_partkey % 190, CASE WHEN p_partkey % 3 = 0 THEN '験' ELSE '' END FROM part WHERE p_partkey % 2 = 0
    UNION ALL SELECT p_partkey, 'fetched', k, (p_partkey * (k + 3)) % 170, '' FROM part, (SELECT unnest([0, 1]) AS k) WHERE p_partkey % 5 <> 0
    UNION ALL SELECT p_partkey, 'added', k, (p_partkey + k * 7) % 230, CASE WHEN p_partkey % 4 = 0 THEN '王' ELSE '' END FROM part, (SELECT unnest([0, 1, 2]) AS k) WHERE p_partkey % 7 <> 0)
), once AS (SELECT entity_id, source, name, min(place) AS place FROM given GROUP BY ALL)"""
_USABLE = "len(regexp_extract_all({}, '[一-鿿]')) >= 2"
_NAMED = f"""{_GIVEN}, lists AS (
  SELECT entity_id, list(name ORDER BY place, name) FILTER (source = 'forced') AS forced, list(name ORDER BY place, name) FILTER (source = 'official') AS official, list(name ORDER BY place, name) FILTER (source = 'fetched') AS fetched, list(name ORDER BY place, name) FILTER (source = 'added') AS added,
         list(name ORDER BY place, name) FILTER (source = 'added' AND {_USABLE.format('name')}) AS usable FROM once GROUP BY entity_id
), picked AS (
  SELECT entity_id, usable[1] AS usable, forced[1] AS f, coalesce(official[1], fetched[1], added[1]) AS before,
         CASE WHEN forced IS NOT NULL THEN 'forced' WHEN official IS NOT NULL AND NOT (regexp_matches(official[1], '[{N.OTHER_FORMS}]') AND coalesce(fetched[1], added[1]) IS NOT NULL AND coalesce(fetched[1], added[1]) <> official[1]) THEN 'official' WHEN fetched IS NOT NULL THEN 'fetched' ELSE 'added' END AS src,
         CASE src WHEN 'forced' THEN forced[1] WHEN 'official' THEN official[1] WHEN 'fetched' THEN fetched[1] ELSE added[1] END AS chosen FROM lists
), named AS (
  SELECT entity_id, CASE WHEN {_USABLE.format('chosen')} THEN chosen ELSE usable END AS name, CASE WHEN {_USABLE.format('chosen')} THEN src ELSE 'added' END AS source, CASE WHEN NOT {_USABLE.format('chosen')} THEN chosen END AS rejected,
         CASE WHEN f IS NOT NULL AND before <> f THEN before END AS replaced FROM picked
), names AS (SELECT * FROM named WHERE name IS NOT NULL),
candidates AS (SELECT DISTINCT c.entity_id, c.name, n.replaced FROM (SELECT entity_id, name FROM once WHERE source IN ('fetched', 'added') UNION SELECT entity_id, replaced FROM names WHERE replaced IS NOT NULL) c JOIN names n USING (entity_id) WHERE c.name <> n.name),
yielded AS (SELECT * FROM candidates WHERE name NOT IN (SELECT name FROM names)),
variants AS (SELECT entity_id, name FROM (SELECT *, count(*) OVER (PARTITION BY name) AS n FROM yielded) WHERE n = 1 OR name = replaced)"""


def _sources(spark, sf_dir):
    part, k = dealt(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey"), F.col("p_partkey")
    name = lambda code, tail: F.concat(F.translate(code.cast("string"), _DIGITS, _HAN), tail)
    entry = lambda when, source, place, code, tail: F.when(when, F.struct(F.lit(source).alias("source"), F.lit(place).alias("place"), name(code, tail).alias("name")))
    none = F.lit("")
    entries = [
        entry(k % 9 == 0, "forced", 0, k % 310, F.lit("王")), entry(k % 2 == 0, "official", 0, k % 190, F.when(k % 3 == 0, "験").otherwise("")),
        *(entry(k % 5 != 0, "fetched", i, (k * (i + 3)) % 170, none) for i in range(2)), *(entry(k % 7 != 0, "added", i, (k + i * 7) % 230, F.when(k % 4 == 0, "王").otherwise("")) for i in range(3)),
    ]
    return part.select(k.alias("entity_id"), F.explode(F.array_compact(F.array(*entries))).alias("e")).select("entity_id", "e.source", "e.place", "e.name")


@query(f"WITH {_NAMED} SELECT entity_id, name, CASE source WHEN 'official' THEN 'A' WHEN 'forced' THEN 'B' ELSE 'C' END AS level, source, rejected FROM names")
def arbitrated_names(spark, sf_dir):
    return N.arbitrated(_sources(spark, sf_dir))[0]


@query(f"WITH {_NAMED} SELECT entity_id, name FROM variants")
def arbitrated_variants(spark, sf_dir):
    return N.arbitrated(_sources(spark, sf_dir))[1]


@query(f"WITH {_NAMED} SELECT alias, entity_id FROM (SELECT name AS alias, entity_id, 0 AS p FROM names UNION ALL SELECT name, entity_id, 1 FROM variants) QUALIFY row_number() OVER (PARTITION BY alias ORDER BY p, entity_id) = 1")
def arbitrated_aliases(spark, sf_dir):
    return N.name_table(*N.arbitrated(_sources(spark, sf_dir)))


def _spoken(spark, sf_dir, one_shorter: bool):
    """Each order names a part by its name and type without the last word, then by two words of these; parts of even
    numbers are known by their name alone."""
    part = table(spark, sf_dir, "part")
    names = part.select(F.col("p_partkey").alias("entity_id"), words(F.when(F.col("p_partkey") % 2 == 1, F.concat_ws(" ", "p_name", "p_type")).otherwise(F.col("p_name"))).alias("units"))
    lines = spread(table(spark, sf_dir, "orders")).select(F.col("o_orderkey").alias("text_id"), (F.col("o_custkey") % 200 + 1).alias("p_partkey"))
    said = lines.join(part.select("p_partkey", words(F.concat_ws(" ", "p_name", "p_type")).alias("w")), "p_partkey")
    units = F.concat(F.array(F.lit("send")), F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), F.array(F.lit("or"), F.lit("the")), F.slice("w", F.lit(2), F.lit(2)))
    return L.fuzzy_classes(said.select("text_id", units.alias("units")), "text_id", names, 2, 6, one_shorter)


@query(None)
def fuzzy_name_spans(spark, sf_dir):
    """Parts of names in orders, the longest first and none over another, by classes: the spans of each order with the
    number of names that have their fragment, and the names of each fragment; held against a loop in the tests."""
    return _spoken(spark, sf_dir, False)


@query(None)
def fuzzy_one_shorter(spark, sf_dir):
    """The same, where a fragment names only names longer by one word."""
    return _spoken(spark, sf_dir, True)
