"""Questions from end to end, and whether what an answer says holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions import parsing as P
from loomspark.functions.encoding import level_label
from loomspark.functions.text import STOPWORDS
from loomspark.operators import asking as Q
from loomspark.operators import evaluation as E
from loomspark.operators.faithfulness import numeric_shares
from loomspark.operators.routing import DIMENSIONS
from loomspark.plans import fixtures as X
from loomspark.plans.answers import _SEEN, _appearances
from loomspark.sources.storage import stored
from loomspark.sources.tables import dealt, sized, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
DIMS = tuple(name for name, _ in DIMENSIONS)


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


TEMPLATES = (
    'What is the power of "{}"?', 'What is the speed of "{}"?', 'What kind of part is "{}"?', 'In how many chapters is "{}"?', 'Describe the story of "{}"', "Explain why the plot turns",
    'Where is "{}" located?', 'Who is the father of "{}"?', 'Something about the range and "{}"', 'Will it rain on "{}"?', 'What is the power of "{}ology"?', 'Who owns "Zz{}", which entity?',
    'Compare the range of "{}" with others', "Which entities have the highest stamina?",
)


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, TEMPLATES)), (F.col("p_partkey") % len(TEMPLATES) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.replace(text, F.lit("{}"), F.col("p_name")).alias("question"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.lower("p_name").alias("name")).agg(F.min("p_partkey").alias("entity_id"))


def _case(cues, otherwise: str, q: str = "low") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({q}, '{cue}') THEN '{name}'" for name, cue in cues) + f" ELSE {otherwise} END"


_ASKED = f"""asked AS (SELECT p_partkey AS query_id, replace([{", ".join(f"'{t}'" for t in TEMPLATES)}][CAST(p_partkey % {len(TEMPLATES)} + 1 AS INTEGER)], '{{}}', p_name) AS question FROM part),
names AS (SELECT lower(p_name) AS name, min(p_partkey) AS entity_id FROM part GROUP BY 1),
terms AS (SELECT *, nullif(lower(regexp_extract(question, '"([^"]+)"', 1)), '') AS term, lower(question) AS low, regexp_replace(lower(question), '"[^"]*"', ' ', 'g') AS q FROM asked),
stood AS (SELECT t.*, n.entity_id, CASE WHEN term IS NULL THEN 'none' WHEN n.entity_id IS NOT NULL THEN 'known' WHEN EXISTS (SELECT 1 FROM names m WHERE starts_with(t.term, m.name) AND length(t.term) - length(m.name) >= 3) THEN 'fabricated' ELSE 'unknown' END AS standing FROM terms t LEFT JOIN names n ON n.name = t.term),
coded_q AS (SELECT *, {_case(Q.INTENTS, "'unknown'", "q")} AS intent, {_case(tuple((n, rf"\b({c})\b") for n, c in DIMENSIONS), "NULL", "q")} AS dim,
CASE WHEN NOT regexp_matches(q, '{Q.DOMAIN}') THEN 'out of domain' WHEN standing = 'fabricated' THEN 'no such variant' WHEN standing = 'unknown' THEN 'unknown name' END AS reason FROM stood),
routed AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'abstain' WHEN regexp_matches(q, '{Q.PLACE}') THEN 'location' WHEN intent <> 'unknown' AND NOT regexp_matches(q, '{Q.OPEN}') THEN 'structured' WHEN regexp_matches(q, '{Q.PERSON}') THEN 'character'
WHEN regexp_matches(q, '{Q.OPEN}') AND standing = 'known' THEN 'entity_semantic' WHEN regexp_matches(q, '{Q.OPEN}') THEN 'semantic' ELSE 'hybrid' END AS route FROM coded_q)"""


def _understood(spark, sf_dir):
    return Q.understood(_questions(spark, sf_dir), _names(spark, sf_dir))


@query(f"WITH {_ASKED} SELECT query_id, term, entity_id, standing, intent, dim, route, reason FROM routed")
def understand_questions(spark, sf_dir):
    """Seven routes and eleven intents, with names that are known, made up from known ones, or unknown."""
    return _understood(spark, sf_dir).select("query_id", "term", "entity_id", "standing", "intent", "dim", "route", "reason")


@query(f"WITH {_ASKED} SELECT route, intent, count(*) AS n FROM routed GROUP BY ALL")
def route_counts(spark, sf_dir):
    return _understood(spark, sf_dir).groupBy("route", "intent").agg(F.count("*").alias("n"))


_LABEL = "CASE WHEN category = 'INFINITE' THEN '∞' WHEN value = 0 THEN 'none' WHEN value BETWEEN 1 AND 5 THEN substring('EDCBA', value, 1) END"
_DIM_NAME = f"[{', '.join(repr(d) for d in DIMS)}][dim + 1]"


def _labels(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, DIMS)), F.col("dim") + 1)
    return X.coded(spark, sf_dir).select("entity_id", name.alias("dim"), level_label(F.col("value"), F.col("category")).alias("label"))


@query(f"""WITH {_ASKED}, {X.CODED_SQL}, {_SEEN}, l AS (SELECT entity_id, {_DIM_NAME} AS dim, {_LABEL} AS label FROM coded), m AS (SELECT entity_id, count(*) AS n FROM seen WHERE kind = 'manga' GROUP BY entity_id)
SELECT query_id, route, CASE WHEN route = 'abstain' THEN 'No answer: ' || reason WHEN route <> 'structured' THEN NULL WHEN intent = 'fact' THEN coalesce(label, 'not known') WHEN intent = 'kind' THEN p_type WHEN intent = 'appearance' THEN CAST(coalesce(n, 0) AS VARCHAR) || ' chapters' END AS answer
FROM routed r LEFT JOIN l ON l.entity_id = r.entity_id AND l.dim = r.dim LEFT JOIN m ON m.entity_id = r.entity_id LEFT JOIN part ON p_partkey = r.entity_id""")
def answer_questions(spark, sf_dir):
    """Question to answer: understood, looked up where structured, told why not where there is none."""
    labels = _labels(spark, sf_dir).where("label is not null").groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct("dim", "label"))).alias("labels"))
    kinds = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_type").alias("kind"))
    chapters = _appearances(spark, sf_dir).where("kind = 'manga'").groupBy("entity_id").agg(F.count("*").alias("n_chapters"))
    return Q.told(_understood(spark, sf_dir), kinds.join(labels, "entity_id", "left").join(chapters, "entity_id", "left")).select("query_id", "route", "answer")


SPOKEN = (
    "What is the power of {}?", 'What kind of part is "{}"?', "In how many chapters is {}?", "Who owns {}, which entity?", "What does {} own?", "How many forms has {}?", "Which moves does {} have?", "Compare the range of {} with others",
    "How many entities have speed level 4?", "Which entities have the highest stamina?", "Which entities have the lowest precision?", "List all entities of potential B", "Describe the story of {}", "Explain the plot of ~", "Will it rain on {}?", 'What is the power of "{}ology"?',
    "Where is {} located?", "Who is the father of {}, by part?", "The power and ~",
)
# What each question above is about, told here by its number and nowhere by its words.
_SPOKEN = f"""q AS (SELECT p_partkey AS query_id, lower(p_name) AS name, p_partkey % {len(SPOKEN)} AS k FROM part), named AS (SELECT lower(p_name) AS name, min(p_partkey) AS entity_id FROM part GROUP BY 1),
asked AS (SELECT query_id, k, CASE WHEN k IN (8, 9, 10, 11, 13, 15, 18) THEN NULL ELSE entity_id END AS entity_id, ['fact', 'kind', 'appearance', 'owner', 'owned', 'forms', 'moves', 'compare', 'count', 'extreme', 'extreme', 'list'][k + 1] AS intent,
  CASE k WHEN 0 THEN 'power' WHEN 7 THEN 'range' WHEN 8 THEN 'speed' WHEN 9 THEN 'stamina' WHEN 10 THEN 'precision' WHEN 11 THEN 'potential' END AS dim,
  CASE WHEN k < 12 THEN 'structured' WHEN k = 12 THEN 'entity_semantic' WHEN k = 13 THEN 'semantic' WHEN k IN (14, 15) THEN 'abstain' WHEN k = 16 THEN 'location' WHEN k = 17 THEN 'character' ELSE 'hybrid' END AS route FROM q JOIN named USING (name)),
vals AS (SELECT entity_id, name, dim, value FROM (SELECT c.entity_id, c.name, ['power', 'speed', 'range', 'stamina', 'precision', 'potential'][c.dim + 1] AS dim, c.value, c.category FROM coded c)),
ranks AS (SELECT dim, value, count(*) AS n, list(name ORDER BY entity_id)[1:3] AS first FROM vals WHERE value IS NOT NULL GROUP BY ALL),
stands AS (SELECT v.entity_id, v.dim, (SELECT coalesce(sum(n), 0) FROM ranks r WHERE r.dim = v.dim AND r.value > v.value) AS above, (SELECT n FROM ranks r WHERE r.dim = v.dim AND r.value = v.value) - 1 AS alike, (SELECT coalesce(sum(n), 0) FROM ranks r WHERE r.dim = v.dim AND r.value < v.value) AS below FROM vals v WHERE v.dim = 'range' AND v.value IS NOT NULL),
owned AS (SELECT p_brand, count(*) AS n, list(p_name ORDER BY p_partkey)[1:3] AS first FROM part GROUP BY p_brand), forms AS (SELECT lower(p_name) AS name, count(*) AS n FROM part GROUP BY 1), moves AS (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY 1),
written AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}')) AS w FROM documents), spoken AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}'), lambda w: w NOT IN ({", ".join(repr(w) for w in STOPWORDS)}))[1:8] AS ws FROM benchmark),
met AS (SELECT DISTINCT item_id FROM (SELECT item_id, unnest(ws) AS w FROM spoken) JOIN written USING (w))"""


@query(f"""WITH {X.CODED_SQL}, {_SEEN}, {_SPOKEN}, m AS (SELECT entity_id, count(*) AS n FROM seen WHERE kind = 'manga' GROUP BY entity_id), l AS (SELECT entity_id, {_DIM_NAME} AS dim, {_LABEL} AS label FROM coded)
SELECT query_id, route, answer, CASE WHEN k = 14 THEN 'out of domain' WHEN k = 15 THEN 'no such variant' WHEN answer IS NULL AND k = 17 THEN 'no record of persons' WHEN answer IS NULL AND k IN (12, 13, 18) THEN 'nothing found' WHEN answer IS NULL THEN 'not on record' END AS reason FROM (
  SELECT query_id, route, k, CASE k WHEN 0 THEN coalesce(label, 'not known') WHEN 1 THEN p_type WHEN 2 THEN coalesce(m.n, 0) || ' chapters' WHEN 3 THEN part.p_brand WHEN 4 THEN owned.n || ': ' || array_to_string(owned.first, '; ') WHEN 5 THEN forms.n || ' forms' WHEN 6 THEN coalesce(moves.n, 0) || ' moves'
    WHEN 7 THEN above || ' above, ' || alike || ' alike, ' || below || ' below' WHEN 8 THEN (SELECT n || ' entities' FROM ranks WHERE dim = 'speed' AND value = 4)
    WHEN 9 THEN (SELECT n || ': ' || array_to_string(first, '; ') FROM ranks WHERE dim = 'stamina' ORDER BY value DESC LIMIT 1) WHEN 10 THEN (SELECT n || ': ' || array_to_string(first, '; ') FROM ranks WHERE dim = 'precision' ORDER BY value LIMIT 1)
    WHEN 11 THEN (SELECT n || ': ' || array_to_string(first, '; ') FROM ranks WHERE dim = 'potential' AND value = 4) WHEN 13 THEN found WHEN 18 THEN found WHEN 16 THEN n_name END AS answer
  FROM (SELECT *, CASE WHEN query_id % (SELECT count(*) FROM benchmark) IN (SELECT item_id FROM met) THEN 'text found' END AS found FROM asked) a LEFT JOIN l ON l.entity_id = a.entity_id AND l.dim = a.dim LEFT JOIN part ON p_partkey = a.entity_id LEFT JOIN m ON m.entity_id = a.entity_id LEFT JOIN owned ON owned.p_brand = part.p_brand LEFT JOIN forms ON forms.name = lower(p_name)
  LEFT JOIN moves ON l_partkey = a.entity_id LEFT JOIN stands s ON s.entity_id = a.entity_id AND s.dim = a.dim LEFT JOIN nation ON n_nationkey = a.entity_id % 25)""")
def spoken_answers(spark, sf_dir):
    """Names without quotation marks, eleven intents, places, and texts for open questions; a reason where nothing is told."""
    from loomspark.functions import text as T
    from loomspark.operators import lexical as L

    part, k = dealt(table(spark, sf_dir, "part"), "p_partkey"), F.col("p_partkey")
    template = F.element_at(F.array(*map(F.lit, SPOKEN)), (k % len(SPOKEN) + 1).cast("int"))
    # '~' are words of a document of the benchmark
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id"), F.array_join(F.slice(T.latin_tokens(F.col("text")), F.lit(1), F.lit(8)), " ").alias("w"))
    n_items = items.count()
    asked = part.select(k.alias("query_id"), F.replace(template, F.lit("{}"), F.col("p_name")).alias("question"), (k % n_items).alias("item_id")).join(F.broadcast(items), "item_id")
    questions = asked.select("query_id", F.replace("question", F.lit("~"), F.col("w")).alias("question"))
    rows = stored(Q.understood(questions, _names(spark, sf_dir), 3), "understood")
    open_ = rows.where("route in ('entity_semantic', 'semantic', 'hybrid')").select("query_id", F.col("rest").alias("text"))
    tokens = T.latin_tokens(F.col("text"), [*T.STOPWORDS, "describe", "story", "explain", "plot", "power"])
    # a text is searched for once, however many questions have it
    texts = stored(open_.select("text").distinct().withColumn("query_id", F.monotonically_increasing_id()), "texts")
    found = stored(L.bm25(texts, table(spark, sf_dir, "documents"), "doc_id", T.latin_tokens(F.col("text")), tokens, 1), "found")
    evidence = open_.join(sized(texts.withColumnRenamed("query_id", "_text").join(sized(found.select(F.col("query_id").alias("_text"), "doc_id")), "_text").select("text", "doc_id")), "text")
    values = X.coded(spark, sf_dir, part).select("entity_id", "name", F.element_at(F.array(*map(F.lit, DIMS)), F.col("dim") + 1).alias("dim"), "value", level_label(F.col("value"), F.col("category")).alias("label"))
    brand = part.withColumn("_n", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")))
    owned = brand.groupBy("p_brand").agg(F.count("*").alias("n_owned"), F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= 3, F.struct("_n", "p_name")))), lambda x: x["p_name"]).alias("owned"))
    forms = part.groupBy(F.lower("p_name").alias("_name")).agg(F.count("*").alias("n_forms"))
    moves = table(spark, sf_dir, "lineitem").where("l_quantity > 25").groupBy(F.col("l_partkey").alias("entity_id")).agg(F.count("*").alias("n_moves"))
    chapters = _appearances(spark, sf_dir).where("kind = 'manga'").groupBy("entity_id").agg(F.count("*").alias("n_chapters"))
    places = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("_k"), F.col("n_name").alias("place"))
    base = part.join(owned, "p_brand").join(sized(forms), F.lower("p_name") == F.col("_name")).join(F.broadcast(places), k % 25 == F.col("_k"), "left")
    facts = base.select(k.alias("entity_id"), F.col("p_type").alias("kind"), F.col("p_brand").alias("owner"), "place", "owned", "n_owned", "n_forms").join(moves, "entity_id", "left").join(chapters, "entity_id", "left")
    level = P.level_asked(F.regexp_replace("question", '"[^"]*"', " "))
    told = Q.answered(rows, facts, values, evidence, level)
    return told.select("query_id", "route", F.when(F.col("source") == "texts", "text found").otherwise(F.col("answer")).alias("answer"), "reason")


def _said(spark, sf_dir):
    k = F.col("p_partkey")
    letter = lambda n: F.substring(F.lit("ABCDE"), (n % 5 + 1).cast("int"), F.lit(1))
    return table(spark, sf_dir, "part").select(k.alias("entity_id"), F.concat(F.lit("Its power is "), letter(k), F.lit(", its speed is not "), letter(k * 3), F.lit("; the range is Great.")).alias("answer"))


@query(f"""WITH {X.CODED_SQL}, l AS (SELECT entity_id, dim, {_LABEL} AS label FROM coded), s AS (SELECT p_partkey AS entity_id, 0 AS dim, substring('ABCDE', p_partkey % 5 + 1, 1) AS grade, false AS negated FROM part UNION ALL SELECT p_partkey, 1, substring('ABCDE', p_partkey * 3 % 5 + 1, 1), true FROM part),
h AS (SELECT s.entity_id, CASE WHEN label IS NOT NULL THEN (label = grade) <> negated END AS holds FROM s LEFT JOIN l ON l.entity_id = s.entity_id AND l.dim = s.dim)
SELECT entity_id, count(*) AS n_said, count(*) FILTER (holds) AS n_held, count(*) FILTER (NOT holds) AS n_contradicted, round(count(*) FILTER (holds) / nullif(count(holds), 0)::DOUBLE, 4) AS share FROM h GROUP BY entity_id""")
def numeric_faithfulness(spark, sf_dir):
    """Grades that answers state or deny against the values on record."""
    return Q.checked(Q.assertions(_said(spark, sf_dir), "entity_id", "answer", DIMS), "entity_id", _labels(spark, sf_dir))


# The answers' templates and what each is worth, by the parts' grades and ranges.
@query("""WITH v AS (SELECT p_partkey AS query_id, p_partkey % 5 AS p, (p_partkey * 3) % 5 AS s, (p_partkey * 7) % 40 + 6 AS r, p_partkey % 6 AS k FROM part),
ok AS (SELECT query_id, CASE k WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN (s = 2)::INT + 1 WHEN 3 THEN (p <> 0)::INT WHEN 4 THEN 1 ELSE 0 END AS n_supported, CASE k WHEN 0 THEN 2 WHEN 2 THEN 2 WHEN 5 THEN 0 ELSE 1 END AS n_said FROM v)
SELECT query_id, n_said::BIGINT AS n_said, n_supported::BIGINT AS n_supported, CASE WHEN n_said > 0 THEN round(n_supported::DOUBLE / n_said, 4) END AS share FROM ok""")
def numeric_windows(spark, sf_dir):
    """Grades, levels, ranges, denials and counts of answers against evidence in running text."""
    k = F.col("p_partkey")
    letter = lambda n: F.substring(F.lit("ABCDE"), (n + 1).cast("int"), F.lit(1))
    power, speed, reach = letter(k % 5), letter(k * 3 % 5), (k * 7 % 40 + 6).cast("string")
    text = F.concat(F.lit("Destructive Power: "), power, F.lit(", Speed: "), speed, F.lit(", Range: "), reach, F.lit(" m. It is 1 of 2 kinds."))
    level = (5 - k % 5).cast("string")
    answers = [
        F.concat(F.lit("Its power is "), power, F.lit(" and its speed is "), speed, F.lit(".")), F.concat(F.lit("破坏力等级定为 "), level, F.lit(" 级。")),
        F.concat(F.lit("Speed is C, the range is "), reach, F.lit(" m")), F.lit("Its power is not A."), F.lit("It has 2 forms."), F.lit("A fine thing in every way."),
    ]
    said = table(spark, sf_dir, "part").select(k.alias("query_id"), F.element_at(F.array(*answers), (k % 6 + 1).cast("int")).alias("answer"), text.alias("text"))
    return numeric_shares(said.select("query_id", "answer"), said.select("query_id", "text"), "query_id", "answer", "text")


@query("SELECT p_partkey AS query_id, CASE WHEN p_partkey % 3 = 0 THEN ['other thing'] ELSE [] END AS foreign_names FROM part")
def entity_consistency(spark, sf_dir):
    answer = F.concat(F.lit('Of "'), "p_name", F.lit('"'), F.when(F.col("p_partkey") % 3 == 0, ' and "Other Thing"').otherwise(""), F.lit("."))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), Q.foreign_names(answer, F.concat(F.lit('Record "'), F.upper("p_name"), F.lit('" and "more"'))).alias("foreign_names"))


@query("SELECT p_partkey AS query_id, p_name || ' is here.' AS sentence FROM part")
def lead_ins(spark, sf_dir):
    lead = F.element_at(F.array(*map(F.lit, ("According to the page: ", "Based on chapter 3, ", "The records state that ", ""))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), Q.strip_lead_in(F.concat(lead, "p_name", F.lit(" is here."))).alias("sentence"))


_SENT = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+([A-Z(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) >= 2)"
_TOK = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"


@query(f"""WITH t AS (SELECT conv_id || '-' || turn AS query_id, role, {_SENT} AS s, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS question FROM conversations), u AS (SELECT query_id, question, unnest(s) AS sentence, unnest(range(len(s))) AS place FROM t WHERE role = 'assistant' AND question IS NOT NULL),
n AS (SELECT query_id, sentence, place, len(list_filter({_TOK.format('question')}, lambda w: list_contains({_TOK.format('sentence')}, w))) AS n_common FROM u)
SELECT query_id, sentence, CAST(place AS INTEGER) AS place, CAST(n_common AS INTEGER) AS n_common FROM n WHERE n_common > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n_common DESC, place) = 1""")
def extractive_answer(spark, sf_dir):
    """The sentence of a turn that shares most words with the turn before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("question", F.lag("text").over(w)).where("role = 'assistant' and question is not null")
    return Q.best_sentence(c.select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), "question", "text"), "query_id", "question", "text")


@query("SELECT n_nationkey, ['金色·体验', '黄金体验'] AS aliases, n_name AS head, ['金色', '体验'] AS short FROM nation")
def alias_extraction(spark, sf_dir):
    text = F.concat("n_name", F.lit(" （金色·体验） (Gold) (黄金体验) （金色·体验）"))
    return table(spark, sf_dir, "nation").withColumn("a", P.han_aliases(text)).select("n_nationkey", F.col("a").alias("aliases"), P.head_name(text).alias("head"), P.short_aliases(F.get("a", F.lit(0))).alias("short"))


@query("SELECT p_partkey, [upper(left(w, 1)) || substring(w, 2), 'McCoy', 'Dragona'] AS owners FROM (SELECT p_partkey, split_part(lower(p_name), ' ', 1) AS w FROM part) WHERE regexp_matches(w, '^[a-z]{3,}$')")
def glued_owners(spark, sf_dir):
    """Three names run together; Mc does not end a name."""
    w = F.substring_index(F.lower("p_name"), " ", 1)
    return table(spark, sf_dir, "part").where(w.rlike("^[a-z]{3,}$")).select("p_partkey", P.repaired_names(F.concat(F.initcap(w), F.lit("McCoyDragona"))).alias("owners"))


@query("SELECT n_nationkey, translate(n_name || '験體經門鬥', '験體經門鬥', '验体经门斗') AS simple FROM nation")
def simple_han(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", P.simple_han(F.concat("n_name", F.lit("験體經門鬥"))).alias("simple"))


_SIZES = "s AS (SELECT size, sum(ceil(length(text) / size::DOUBLE)) AS n_windows, avg(length(text) % size / size::DOUBLE) AS tail FROM documents, (SELECT unnest([256, 512, 1024]) AS size) GROUP BY size), e AS (SELECT min(n_windows) AS a, max(n_windows) AS b, min(tail) AS c, max(tail) AS d FROM s)"


@query(f"WITH {_SIZES} SELECT CAST(size AS INTEGER) AS size, round(0.4::DOUBLE * (1 - round(CASE WHEN b > a THEN (n_windows - a) / (b - a) ELSE 0 END, 4)) + 0.6::DOUBLE * round(CASE WHEN d > c THEN (tail - c) / (d - c) ELSE 0 END, 4), 3) AS score FROM s, e")
def size_scores(spark, sf_dir):
    """Window sizes by few windows (0.4) and full last windows (0.6), each scaled over the sweep; one job for all sizes."""
    d = table(spark, sf_dir, "documents").select(F.length("text").alias("n"), F.explode(F.array(*map(F.lit, (256, 512, 1024)))).alias("size"))
    per = d.groupBy("size").agg(F.sum(F.ceil(F.col("n") / F.col("size").cast("double"))).cast("double").alias("n_windows"), F.avg(F.col("n") % F.col("size") / F.col("size").cast("double")).alias("tail"))
    return E.min_max(per, ["n_windows", "tail"]).select("size", F.round(0.4 * (1 - F.col("n_windows_scaled")) + 0.6 * F.col("tail_scaled"), 3).alias("score"))
