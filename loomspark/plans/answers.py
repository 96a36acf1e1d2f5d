"""Answer queries: each is one fixed plan over entities, appearances, places and people derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import parsing as P
from loomspark.functions import records as N
from loomspark.operators import answers as A
from loomspark.plans import fixtures as X
from loomspark.plans.structured import _WIDE, wide
from loomspark.sources.tables import small, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


KINDS = ("cover", "manga", "manga", "anime")


def _appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, kind, chapter: an appearance for each order line; every eleventh has no chapter."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("l_linenumber") % 4 + 1).cast("int"))
    chapter = F.when(F.col("l_orderkey") % 11 != 0, F.col("l_orderkey") % 752 + 1)
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity_id"), kind.alias("kind"), chapter.alias("chapter"))


_SEEN = "seen AS (SELECT l_partkey AS entity_id, ['cover', 'manga', 'manga', 'anime'][CAST(l_linenumber % 4 + 1 AS INTEGER)] AS kind, CASE WHEN l_orderkey % 11 <> 0 THEN l_orderkey % 752 + 1 END AS chapter FROM lineitem)"


@query(f"WITH {_WIDE}, {_SEEN}, n AS (SELECT entity_id, count(*) AS n FROM seen GROUP BY entity_id) SELECT entity_id, name, [v0, v1, v2, v3, v4, v5] AS dims, composite, missing, coalesce(n, 0) AS n_appearances FROM (SELECT *, v0 + v1 + v2 + v3 + v4 + v5 AS composite, list_filter([CASE WHEN v0 IS NULL THEN 'power' END, CASE WHEN v1 IS NULL THEN 'speed' END, CASE WHEN v2 IS NULL THEN 'range' END, CASE WHEN v3 IS NULL THEN 'stamina' END, CASE WHEN v4 IS NULL THEN 'precision' END, CASE WHEN v5 IS NULL THEN 'potential' END], lambda x: x IS NOT NULL) AS missing FROM wide) LEFT JOIN n USING (entity_id)")
def entity_card(spark, sf_dir):
    w = wide(spark, sf_dir)
    counts = _appearances(spark, sf_dir).groupBy("entity_id").agg(F.count("*").alias("n"))
    missing = A.missing_fields({d: F.col(f"v{i}") for i, d in enumerate(("power", "speed", "range", "stamina", "precision", "potential"))})
    return w.join(counts, "entity_id", "left").select("entity_id", "name", F.array(*(f"v{d}" for d in range(6))).alias("dims"), "composite", missing.alias("missing"), F.coalesce("n", F.lit(0)).alias("n_appearances"))


@query(f"WITH {_SEEN} SELECT entity_id, count(*) FILTER (kind = 'manga') AS n_manga, count(*) FILTER (kind = 'anime') AS n_anime, count(*) FILTER (kind = 'cover') AS n_cover, min(CASE WHEN kind = 'manga' THEN chapter END) AS first_chapter, count(*) FILTER (kind = 'anime') > 0 AS in_anime FROM seen GROUP BY entity_id")
def appearance_summary(spark, sf_dir):
    """Counts by kind, whether there is any, and the first real appearance, which is of the manga only."""
    kind = F.col("kind")
    n = {k: F.count_if(kind == k) for k in ("manga", "anime", "cover")}
    return _appearances(spark, sf_dir).groupBy("entity_id").agg(*(c.alias(f"n_{k}") for k, c in n.items()), F.min(F.when(kind == "manga", F.col("chapter"))).alias("first_chapter"), (n["anime"] > 0).alias("in_anime"))


@query(f"WITH {_SEEN}, d AS (SELECT DISTINCT * FROM seen WHERE kind <> 'cover') SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY chapter NULLS LAST, kind) AS INTEGER) AS position FROM d) WHERE position <= 20")
def appearance_list(spark, sf_dir):
    seen = _appearances(spark, sf_dir).where("kind <> 'cover'").distinct()
    return A.first_per(seen, ["entity_id"], 20, F.col("chapter").asc_nulls_last(), F.col("kind"))


@query(f"WITH {_SEEN} SELECT DISTINCT chapter, entity_id, count(DISTINCT entity_id) OVER (PARTITION BY chapter) AS n_entities FROM seen WHERE chapter IS NOT NULL")
def chapter_entities(spark, sf_dir):
    """Reverse lookup: who is in a chapter, and how many."""
    rows = _appearances(spark, sf_dir).where("chapter is not null").select("chapter", "entity_id").distinct()
    return rows.join(rows.groupBy("chapter").agg(F.count("*").alias("n_entities")), "chapter")


@query("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS position, left(text, 700) AS text, length(text) > 700 AS cut FROM conversations WHERE role = 'assistant'")
def move_list(spark, sf_dir):
    """An owner's items in order with at most 700 characters of text, which is the form of this answer."""
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return A.first_per(rows, ["conv_id"], 1 << 30, F.col("turn")).select("conv_id", "turn", "position", F.substring("text", 1, 700).alias("text"), (F.length("text") > 700).alias("cut"))


ORIGINS = ("Stand Arrow → Enya (Signal)", "Natural-born user", "Devil's Palm Exposure", "Saint's Corpse (left eye)", "Merging with a baby", "Written instructions", "Son of the owner", "", "Not told")
_ORIGIN_OF = "SELECT p_partkey AS entity_id, ['Stand Arrow → Enya (Signal)', 'Natural-born user', 'Devil''s Palm Exposure', 'Saint''s Corpse (left eye)', 'Merging with a baby', 'Written instructions', 'Son of the owner', '', 'Not told'][CAST(p_partkey % 9 + 1 AS INTEGER)] AS raw FROM part"
_ORIGIN_SQL = f"""origins AS (SELECT entity_id, raw, CASE WHEN contains(lower(raw), 'palm exposure') THEN 'exposure' WHEN contains(lower(raw), 'corpse') THEN 'saint_corpse' WHEN contains(lower(raw), 'arrow') THEN 'arrow'
WHEN contains(lower(raw), 'natural-born') THEN 'natural' WHEN contains(lower(raw), 'merging') THEN 'merge' WHEN contains(lower(raw), 'instructions') THEN 'technique' WHEN contains(lower(raw), 'son of') THEN 'bloodline' ELSE 'unknown' END AS kind,
CASE WHEN contains(raw, '→') THEN trim(split_part(split_part(raw, '→', 2), '(', 1)) END AS note FROM ({_ORIGIN_OF}))"""


def _origins(spark, sf_dir):
    raw = F.element_at(F.array(*map(F.lit, ORIGINS)), (F.col("p_partkey") % len(ORIGINS) + 1).cast("int"))
    found = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), raw.alias("raw"))
    return found.withColumn("o", P.origin(F.col("raw"))).select("entity_id", "raw", "o.kind", "o.note")


@query(f"WITH {_ORIGIN_SQL} SELECT * FROM origins")
def parse_origins(spark, sf_dir):
    return _origins(spark, sf_dir)


@query(f"WITH {_ORIGIN_SQL} SELECT kind, count(*) AS n, count(note) AS n_with_note FROM origins GROUP BY kind")
def origin_distribution(spark, sf_dir):
    return _origins(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.count("note").alias("n_with_note"))


@query("""WITH said AS (SELECT p_partkey AS query_id, upper(n_name) AS term FROM part JOIN nation ON p_partkey % 30 = n_nationkey UNION ALL SELECT p_partkey, 'NOWHERE' FROM part WHERE p_partkey % 30 >= 25)
SELECT query_id, term, count(s_suppkey) AS n_owned, min(s_suppkey) AS lowest FROM said LEFT JOIN (SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey) ON lower(n_name) = lower(term) GROUP BY ALL""")
def owned_by(spark, sf_dir):
    """What an owner has, matched without regard to case; an unknown owner has nothing."""
    nation = table(spark, sf_dir, "nation")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), (F.col("p_partkey") % 30).alias("k"))
    asked = part.join(small(nation), F.col("k") == F.col("n_nationkey"), "left").select("query_id", F.coalesce(F.upper("n_name"), F.lit("NOWHERE")).alias("term"))
    owned = table(spark, sf_dir, "supplier").join(small(nation), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.lower("n_name").alias("key")).agg(F.count("*").alias("n"), F.min("s_suppkey").alias("lowest"))
    return asked.join(owned, F.lower("term") == F.col("key"), "left").select("query_id", "term", F.coalesce("n", F.lit(0)).alias("n_owned"), "lowest")


@query("""WITH e AS (SELECT p_partkey AS entity_id, lower(p_name) AS name, p_brand FROM part), asked AS (SELECT p_partkey AS query_id, CASE p_partkey % 4 WHEN 0 THEN lower(p_brand) WHEN 1 THEN lower(p_name) WHEN 2 THEN split_part(lower(p_name), ' ', 1) ELSE 'zz' || p_partkey END AS term FROM part),
tried AS (SELECT lower(p_brand) AS term, entity_id, 0 AS way FROM e UNION ALL SELECT name, entity_id, 1 FROM e UNION ALL SELECT w, entity_id, 2 FROM (SELECT entity_id, unnest(string_split(name, ' ')) AS w FROM e)),
met AS (SELECT DISTINCT query_id, way, entity_id FROM asked JOIN tried USING (term)), best AS (SELECT query_id, min(way) AS way FROM met GROUP BY query_id),
c AS (SELECT query_id, way, count(*) AS n, list_sort(list(entity_id))[1:8] AS ids, min(entity_id) AS one FROM met JOIN best USING (query_id, way) GROUP BY ALL)
SELECT query_id, term, CAST(way AS INTEGER) AS way, coalesce(n, 0) AS n_candidates, ids AS candidates, CASE WHEN n = 1 THEN one END AS entity_id, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'one' ELSE 'ambiguous' END AS outcome FROM asked LEFT JOIN c USING (query_id)""")
def name_cascade(spark, sf_dir):
    """Alias, then whole name, then a word of the name. The terms of each kind are counted once, not once a question."""
    part = table(spark, sf_dir, "part")
    e = part.select(F.col("p_partkey").alias("entity_id"), F.lower("p_name").alias("name"), F.lower("p_brand").alias("alias"))
    k = F.col("p_partkey") % 4
    term = F.when(k == 0, F.lower("p_brand")).when(k == 1, F.lower("p_name")).when(k == 2, F.substring_index(F.lower("p_name"), " ", 1)).otherwise(F.concat(F.lit("zz"), "p_partkey"))
    asked = part.select(F.col("p_partkey").alias("query_id"), term.alias("term"))
    ways = [e.select(F.col("alias").alias("term"), "entity_id"), e.select(F.col("name").alias("term"), "entity_id"), e.select(F.explode(F.split("name", " ")).alias("term"), "entity_id")]
    terms = asked.select("term").distinct()
    found = A.cascade(terms.select(F.col("term").alias("query_id"), "term"), ways).drop("query_id")
    return asked.join(found, "term").select("query_id", "term", "way", "n_candidates", "candidates", "entity_id", "outcome")


@query("SELECT label, entity_id, position FROM (SELECT label, entity_id, CAST(row_number() OVER (PARTITION BY label ORDER BY name, entity_id) AS INTEGER) AS position FROM (SELECT DISTINCT unnest(string_split(p_type, ' ')) AS label, p_partkey AS entity_id, p_name AS name FROM part))")
def kind_list(spark, sf_dir):
    """Entities of a kind, in order of their names."""
    rows = table(spark, sf_dir, "part").select(F.explode(F.array_distinct(F.split("p_type", " "))).alias("label"), F.col("p_partkey").alias("entity_id"), "p_name")
    return A.first_per(rows, ["label"], 1 << 30, F.col("p_name"), F.col("entity_id")).select("label", "entity_id", "position")


@query("SELECT p_partkey AS entity_id, list_contains(string_split(p_type, ' '), 'STEEL') AS is_steel, contains(lower(p_type), 'bra') AS sounds_brassy FROM part")
def kind_check(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.array_contains(F.split("p_type", " "), "STEEL").alias("is_steel"), F.contains(F.lower("p_type"), F.lit("bra")).alias("sounds_brassy"))


@query("SELECT p_brand AS brand, p_partkey AS entity_id, p_name AS name, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS INTEGER) AS position FROM part WHERE p_size > 10")
def part_list(spark, sf_dir):
    rows = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"))
    return A.first_per(rows, ["brand"], 1 << 30, F.col("name"), F.col("entity_id"))


@query("SELECT brand, count(*) AS n, CAST((SELECT count(*) FROM part WHERE p_partkey % 7 = 0) AS BIGINT) AS n_unknown FROM (SELECT CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS brand FROM part) WHERE brand IS NOT NULL GROUP BY brand")
def part_stats_unknown(spark, sf_dir):
    """Counts by group, and beside each the number of rows whose group is not known."""
    rows = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 7 != 0, F.col("p_brand")).alias("brand"))
    counts = rows.groupBy("brand").agg(F.count("*").alias("n"))
    unknown = rows.agg(F.count_if(F.col("brand").isNull()).alias("n_unknown"))
    return counts.where("brand is not null").join(F.broadcast(unknown))


@query(f"WITH {X.CODED_SQL} SELECT dim, count(value) AS n_valued, count(*) FILTER (category = 'INFINITE') AS n_infinite, count(*) FILTER (category IN ('CONDITIONAL', 'CONDITIONAL_NO_BASE')) AS n_conditional FROM coded GROUP BY dim")
def extreme_caveats(spark, sf_dir):
    return A.off_scale_notes(X.coded(spark, sf_dir))


ROLES = ("Older Brother", "Younger Brother", "Half Brother", "Grandfather", "Father", "Great-uncle", "Aunt", "")


@query("""WITH r AS (SELECT c_custkey, c_name AS name, nullif(['Older Brother', 'Younger Brother', 'Half Brother', 'Grandfather', 'Father', 'Great-uncle', 'Aunt', ''][CAST(c_custkey % 8 + 1 AS INTEGER)], '') AS role FROM customer)
SELECT c_custkey, name, role, CASE WHEN role LIKE '%Brother' THEN 'brother' WHEN role = 'Great-uncle' THEN 'uncle' ELSE lower(role) END AS base, CASE role WHEN 'Older Brother' THEN 'older' WHEN 'Younger Brother' THEN 'younger' END AS age,
CASE role WHEN 'Older Brother' THEN 'exact' WHEN 'Younger Brother' THEN 'contrast' WHEN 'Half Brother' THEN 'loose' END AS match FROM r""")
def relatives_match(spark, sf_dir):
    """Everyone's relatives against the question for an older brother."""
    role = F.element_at(F.array(*map(F.lit, ROLES)), (F.col("c_custkey") % len(ROLES) + 1).cast("int"))
    entry = F.concat("c_name", F.when(role != "", F.concat(F.lit(" ("), role, F.lit(")"))).otherwise(""))
    rows = table(spark, sf_dir, "customer").withColumn("r", N.relative(entry))
    return rows.select("c_custkey", "r.name", "r.role", "r.base", "r.age", N.relative_match(F.col("r"), "brother", "older").alias("match"))


_EDGES = "e AS (SELECT l_suppkey AS location_id, l_partkey AS entity_id, max(CAST(l_linenumber % 3 = 1 AS INTEGER)) AS strong FROM lineitem GROUP BY ALL)"


def _related(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("location_id"), F.col("l_partkey").alias("entity_id"), "l_linenumber")
    return A.related(l, "location_id", "entity_id", F.col("l_linenumber") % 3 == 1)


@query(f"WITH {_EDGES} SELECT location_id, CAST(sum(strong) AS BIGINT) AS n_strong, count(*) FILTER (strong = 0) AS n_weak FROM e GROUP BY location_id")
def location_related(spark, sf_dir):
    """Entities told of on the place's own page are strong, those whose page names the place weak; each counts once."""
    return _related(spark, sf_dir).groupBy("location_id").agg(F.sum("strong").alias("n_strong"), F.count_if(F.col("strong") == 0).alias("n_weak"))


@query(f"WITH {_EDGES} SELECT * FROM (SELECT location_id, entity_id, CAST(row_number() OVER (PARTITION BY location_id ORDER BY entity_id) AS INTEGER) AS position FROM e WHERE strong = 1) WHERE position <= 10")
def location_strong_list(spark, sf_dir):
    rows = _related(spark, sf_dir).where("strong = 1").select("location_id", "entity_id")
    return A.first_per(rows, ["location_id"], 10, F.col("entity_id"))


@query("SELECT r_name AS place, count(DISTINCT n_nationkey) AS n_within, count(s_suppkey) AS n_entities FROM region JOIN nation ON r_regionkey = n_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_name")
def location_list(spark, sf_dir):
    held = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    n = table(spark, sf_dir, "nation").join(held, "n_nationkey", "left")
    return n.join(small(table(spark, sf_dir, "region")), F.col("r_regionkey") == F.col("n_regionkey")).groupBy(F.col("r_name").alias("place")).agg(F.count_distinct("n_nationkey").alias("n_within"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_entities"))


@query("SELECT s_suppkey, [[s_name, n_name, r_name], [n_name || ' Harbour', r_name]] AS paths FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def place_path_list(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    rows = t("supplier").join(small(t("nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(small(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.concat("s_name", F.lit(",  "), "n_name", F.lit(", "), "r_name", F.lit(" <br/>"), "n_name", F.lit(" Harbour,"), "r_name", F.lit(","))
    return rows.select("s_suppkey", P.place_paths(text).alias("paths"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN p_size END AS number, CASE WHEN p_partkey % 5 > 0 THEN p_name END AS name FROM part")
def part_headings(spark, sf_dir):
    text = F.when(F.col("p_partkey") % 5 > 0, F.concat(F.lit("Part "), "p_size", F.lit(": "), "p_name")).otherwise("Prologue")
    return table(spark, sf_dir, "part").withColumn("x", P.part_heading(text)).select("p_partkey", "x.number", "x.name")


@query("SELECT p_partkey AS query_id, CASE WHEN p_partkey % 3 = 0 THEN CAST(6 - (p_partkey % 5 + 1) AS INTEGER) WHEN p_partkey % 3 = 1 THEN CAST(p_partkey % 6 AS INTEGER) END AS level, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS part FROM part")
def asked_slots(spark, sf_dir):
    """Level and part that a question names."""
    key = F.col("p_partkey")
    level = F.when(key % 3 == 0, F.concat(F.lit("grade "), F.substring(F.lit("ABCDE"), (key % 5 + 1).cast("int"), F.lit(1)))).when(key % 3 == 1, F.concat(F.lit("level "), (key % 6).cast("string"))).otherwise("good")
    asked = F.concat(F.lit("which ones are "), level, F.when(key % 2 == 0, F.concat(F.lit(" in part "), "p_size")).otherwise(""), F.lit("?"))
    return table(spark, sf_dir, "part").select(key.alias("query_id"), P.level_asked(asked).alias("level"), P.part_asked(asked).alias("part"))


@query("SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END, length(text) DESC, doc_id) AS INTEGER) AS position FROM documents QUALIFY position <= 3")
def priority_sort(spark, sf_dir):
    """An owner's three best chunks: by priority of their kind, the longer first, then by id."""
    kind = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).otherwise(2)
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", kind.alias("kind"), F.length("text").alias("n"))
    return A.first_per(rows, ["source"], 3, F.col("kind"), F.col("n").desc(), F.col("doc_id")).select("doc_id", "source", "position")


@query("SELECT p_partkey, p_type || ' ' || p_name || p_name || ' ' || p_brand || p_brand || ' ' || CAST(p_size AS VARCHAR) AS indexed FROM part")
def field_weighting(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", P.weighted_fields(F.col("p_type"), F.col("p_name"), F.col("p_brand"), F.col("p_size").cast("string")).alias("indexed"))


@query("SELECT p_partkey, list_filter(w, lambda x, i: list_position(w, x) = i) AS words FROM (SELECT p_partkey, string_split(lower(p_name || ' ' || p_type || ' ' || p_name), ' ') AS w FROM part)")
def ordered_distinct(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", P.ordered_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type", "p_name")), " ")).alias("words"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 <> 2 THEN 'DU' END AS work, CAST(n_nationkey * 3 + 1 AS INTEGER) AS low, CAST(n_nationkey * 3 + 9 AS INTEGER) AS high FROM nation")
def arc_spans(spark, sf_dir):
    n = F.col("n_nationkey")
    text = F.when(n % 3 == 2, F.concat(F.lit("Chapters "), n * 3 + 1, F.lit(" - "), n * 3 + 9)).otherwise(F.concat(F.lit("DU "), n * 3 + 9, F.lit(", DU "), n * 3 + 1, F.lit("-"), n * 3 + 4))
    return table(spark, sf_dir, "nation").withColumn("x", P.chapter_span(text)).select("n_nationkey", "x.work", "x.low", "x.high")


@query("SELECT n_nationkey, [['Name', 'Region'], [n_name, CAST(n_regionkey AS VARCHAR)]] AS cells FROM nation")
def html_table_rows(spark, sf_dir):
    """Rows of two cells of the first table; the row that spans both columns is no row of two cells."""
    html = F.concat(F.lit("<p>x</p><table class=a>\n<tr><th>Name</th><th>Region</th></tr><tr><td colspan=2>all</td></tr><tr><td><b>"), "n_name", F.lit("</b></td>\n<td> "), "n_regionkey", F.lit("</td></tr></table><table><tr><td>1</td><td>2</td></tr></table>"))
    return table(spark, sf_dir, "nation").select("n_nationkey", P.html_rows(html, 2).alias("cells"))


@query("SELECT n_nationkey, n_name AS name, '{{ruby|' || n_name || '|x}}' AS nested, '[[a|' || n_name || ']]' AS linked, CAST(3 AS INTEGER) AS n_fields FROM nation")
def infobox_fields(spark, sf_dir):
    """Fields of the outermost template; bars within nested braces and links do not cut, the first of a key counts."""
    text = F.concat(F.lit("before {{other|{{x}}}} {{Info\n|name = "), "n_name", F.lit("\n|alt={{ruby|"), "n_name", F.lit("|x}}\n|link = [[a|"), "n_name", F.lit("]]\n|name = later}} after {{Info|name = open"))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.element_at(P.templates("Info")(text), 1).alias("t")).withColumn("f", P.template_fields("t"))
    return rows.select("n_nationkey", F.col("f")["name"].alias("name"), F.col("f")["alt"].alias("nested"), F.col("f")["link"].alias("linked"), F.size("f").alias("n_fields"))


@query("SELECT p_partkey, coalesce(curated, inferred) AS value, CASE WHEN curated <> inferred THEN 'inferred ' || inferred || ', curated ' || curated END AS note FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS curated, CASE WHEN p_partkey % 3 > 0 THEN CAST(p_size + p_partkey % 5 - 2 AS INTEGER) END AS inferred FROM part)")
def preferred_source(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").withColumn("x", A.preferred(F.when(k % 2 == 0, F.col("p_size")), F.when(k % 3 > 0, (F.col("p_size") + k % 5 - 2).cast("int"))))
    return rows.select("p_partkey", "x.value", "x.note")
