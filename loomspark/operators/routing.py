"""Understanding of questions: intent, dimension, route with explicit abstention, and follow-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Cue words. Order decides; comparing and kinds come before owners, extremes and facts.
INTENTS = (
    ("compare", r"\b(versus|vs|compare|stronger than|weaker than)\b"),
    ("kind", r"\bwhat (type|kind) of\b"),
    ("owner", r"\b(owner of|who owns|owned by)\b"),
    ("count", r"\bhow many\b"),
    ("extreme", r"\b(highest|lowest|strongest|weakest|most|least|top)\b"),
    ("list", r"\b(list|which entities|all entities)\b"),
    ("fact", r"\bwhat is the\b"),
)
DIMENSIONS = (("power", "power|strength"), ("speed", "speed|fast"), ("range", "range|reach"), ("stamina", "stamina|durability"), ("precision", "precision|accuracy"), ("potential", "potential|growth"))
DOMAIN = r"\b(entity|entities|part|parts|power|speed|range|stamina|precision|potential|owner|owns|story|plot|describe)\b"
OPEN = r"\b(why|how does|describe|explain|story|plot)\b"
PRONOUN = r"\b(it|its|his|her|their|that one)\b"
FALSE_PRONOUN = r"\b(it is (raining|late|true)|its own)\b"


def intent(question: Column) -> Column:
    q = F.lower(question)
    out = None
    for name, cue in INTENTS:
        out = F.when(q.rlike(cue), name) if out is None else out.when(q.rlike(cue), name)
    return out.otherwise("unknown")


def dimension(question: Column) -> Column:
    q = F.lower(question)
    out = None
    for name, cue in DIMENSIONS:
        hit = q.rlike(rf"\b({cue})\b")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def route(questions: DataFrame) -> DataFrame:
    """questions: query_id, question. Adds intent, dim and route: what has nothing to do with the domain
    abstains, open questions are semantic, known intents structured, what has a domain word only hybrid."""
    q = F.lower("question")
    coded = questions.withColumn("intent", intent(F.col("question"))).withColumn("dim", dimension(F.col("question")))
    return coded.withColumn("route", F.when(~q.rlike(DOMAIN), "abstain").when(q.rlike(OPEN), "semantic").when(F.col("intent") != "unknown", "structured").otherwise("hybrid"))


def is_follow_up(question: Column) -> Column:
    """Does a pronoun stand in the question, apart from fixed phrases?"""
    return F.regexp_replace(F.lower(question), FALSE_PRONOUN, " ").rlike(PRONOUN)


def resolve_pronoun(question: Column, context: Column) -> Column:
    """The first pronoun replaced by the entity in context; unchanged without a pronoun or context."""
    first = F.regexp_extract(question, "(?i)" + PRONOUN, 0)
    at = F.instr(question, first)
    return F.when(is_follow_up(question) & context.isNotNull() & (first != ""), F.concat(F.substr(question, F.lit(1), at - 1), context, F.substr(question, at + F.length(first)))).otherwise(question)


TEMPLATES = (
    "What is the power of {}?", "Who owns {}, which part?", "Which entities have the highest speed?", "How many entities are like {}?",
    "Compare the range of {} and others", "Describe the story of {}", "Explain why the plot has {}", "Will it rain on {} today?",
)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for each part, by its key's remainder."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = F.element_at(F.array(*map(F.lit, TEMPLATES)), (F.col("p_partkey") % len(TEMPLATES) + 1).cast("int"))
    return part.select(F.col("p_partkey").alias("query_id"), F.replace(text, F.lit("{}"), F.col("p_name")).alias("question"))


def _case(pairs: tuple, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(q, '{cue}') THEN '{name}'" for name, cue in pairs) + f" ELSE {otherwise} END"


ROUTE_SQL = f"""SELECT query_id, intent, dim, CASE WHEN NOT regexp_matches(q, '{DOMAIN}') THEN 'abstain' WHEN regexp_matches(q, '{OPEN}') THEN 'semantic' WHEN intent <> 'unknown' THEN 'structured' ELSE 'hybrid' END AS route
FROM (SELECT query_id, q, {_case(INTENTS, "'unknown'")} AS intent, {_case(tuple((n, rf"\b({c})\b") for n, c in DIMENSIONS), "NULL")} AS dim
FROM (SELECT p_partkey AS query_id, lower(replace([{", ".join(f"'{t}'" for t in TEMPLATES)}][CAST(p_partkey % 8 + 1 AS INTEGER)], '{{}}', p_name)) AS q FROM part))"""
