"""From a question to an answer: names said, whether they are known, intent, one of seven routes, and what is told."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.text import sentences, word_string, words
from loomspark.operators.linking import longest_match
from loomspark.operators.routing import dimension
from loomspark.sources.storage import stored
from loomspark.sources.tables import CELLS_A_TASK, parts_of, sized

# Cue words in the order in which they count.
INTENTS = (
    ("appearance", r"\b(appears?|appearances?|chapters?|episodes?|debut)\b"),
    ("moves", r"\b(moves|techniques)\b"),
    ("compare", r"\b(versus|vs|compare|stronger than|weaker than)\b"),
    ("kind", r"\b(what (type|kind) of|close.range|long.range)\b"),
    ("owner", r"\b(owner of|who owns|owned by)\b"),
    ("owned", r"\b(belongs to|what does .* own)\b"),
    ("forms", r"\b(forms|which form)\b"),
    ("count", r"\bhow many\b"),
    ("extreme", r"\b(highest|lowest|strongest|weakest|most|least|top)\b"),
    ("list", r"\b(list|which entities|all entities)\b"),
    ("fact", r"\bwhat is the\b"),
)
DOMAIN = r"\b(entity|entities|parts?|power|speed|range|stamina|precision|potential|owner|owns?|appear|appears|moves|forms|place|located|harbour|brother|father|story|plot|describe|chapters?)\b"
PLACE = r"\b(place|located|harbour|where is)\b"
LOWEST = r"\b(lowest|weakest|least)\b"
PERSON = r"\b(brother|sister|father|mother|born|height|blood type)\b"
OPEN = r"\b(why|how does|describe|explain|story|plot)\b"
LEAD_IN = r"(?i)^\s*((according to|based on|from) [^,:]{1,60}[,:]|the (evidence|records?) (says?|states?) that)\s*"


def first_of(text: Column, cues: tuple, otherwise: str) -> Column:
    """The name of the first cue that the lower-case text has."""
    low = F.lower(text)
    return reduce(lambda out, cue: out.when(low.rlike(cue[1]), cue[0]), cues[1:], F.when(low.rlike(cues[0][1]), cues[0][0])).otherwise(otherwise)


def said_names(text: Column) -> Column:
    """Names between quotation marks, in lower case and in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit('"([^"]+)"'), F.lit(1)), lambda t: F.lower(F.trim(t)))


def known_names(asked: DataFrame, names: DataFrame, least_suffix: int = 3) -> DataFrame:
    """asked: query_id, term. names: name (lower case), entity_id. Adds entity_id and standing: known, fabricated (a
    known name with ``least_suffix`` or more letters behind it), unknown, or none without a term. Beginnings of a term
    meet names by equality, so nothing is compared pair by pair."""
    terms = asked.where("term is not null").select("term").distinct()
    names = sized(names.groupBy("name").agg(F.min("entity_id").alias("entity_id")))
    exact = terms.join(names, F.col("term") == F.col("name")).select("term", "entity_id")
    # only beginnings as long as some name are cut, so a long term costs no more than there are lengths of names
    sizes = names.agg(F.array_sort(F.collect_set(F.length("name"))).alias("sizes"))
    starts = terms.join(F.broadcast(sizes)).withColumn("size", F.explode(F.filter("sizes", lambda n: n <= F.length("term") - least_suffix))).withColumn("start", F.expr("left(term, size)"))
    made_up = starts.join(names.select(F.col("name").alias("start")), "start", "left_semi").select("term").distinct().withColumn("longer", F.lit(True))
    out = asked.join(exact, "term", "left").join(made_up, "term", "left")
    standing = F.when(F.col("term").isNull(), "none").when(F.col("entity_id").isNotNull(), "known").when(F.col("longer"), "fabricated").otherwise("unknown")
    return out.withColumn("standing", standing).drop("longer")


def asked_names(questions: DataFrame, names: DataFrame, longest: int = 0) -> DataFrame:
    """questions: query_id, question. Adds term, entity_id, standing (``known_names``) and rest, the lower-case question
    without what stands between quotation marks and without the name, which are no cues. A question without a quoted
    name is about the longest of ``names`` of up to ``longest`` words that stands in it as words."""
    asked = questions.withColumn("term", F.get(said_names(F.col("question")), F.lit(0)))
    rest = F.lower(F.regexp_replace(F.coalesce("question", F.lit("")), '"[^"]*"', " "))
    if not longest:
        return known_names(asked, names).withColumn("rest", rest)
    plain = asked.where("term is null and query_id is not null").select("query_id", "question")
    hit = longest_match(plain, names.groupBy("name").agg(F.min("entity_id").alias("entity_id")), longest).select("query_id", F.col("name").alias("_hit"))
    rows = asked.join(hit, "query_id", "left")
    bare = F.concat(F.lit(" "), word_string(rest), F.lit(" "))
    rest = F.when(F.col("_hit").isNull(), rest).otherwise(F.replace(bare, F.concat(F.lit(" "), F.col("_hit"), F.lit(" ")), F.lit("  ")))
    return known_names(rows.withColumn("rest", rest).withColumn("term", F.coalesce("term", "_hit")).drop("_hit"), names)


def understood(questions: DataFrame, names: DataFrame, longest: int = 0) -> DataFrame:
    """questions: query_id, question. Adds term, entity_id, standing, intent, dim, route and reason (why there is no
    answer). The routes in order: abstain, location, structured, character, entity_semantic, semantic, hybrid."""
    q = F.col("rest")
    rows = asked_names(questions, names, longest).withColumn("intent", first_of(q, INTENTS, "unknown")).withColumn("dim", dimension(q))
    reason = F.when(~q.rlike(DOMAIN), "out of domain").when(F.col("standing") == "fabricated", "no such variant").when(F.col("standing") == "unknown", "unknown name")
    rows = rows.withColumn("reason", reason)
    opened = q.rlike(OPEN)
    route = (
        F.when(F.col("reason").isNotNull(), "abstain").when(q.rlike(PLACE), "location").when((F.col("intent") != "unknown") & ~opened, "structured")
        .when(q.rlike(PERSON), "character").when(opened & (F.col("standing") == "known"), "entity_semantic").when(opened, "semantic").otherwise("hybrid")
    )
    return rows.withColumn("route", route)


def told(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """rows of ``understood``; facts: entity_id, labels (map from dimension to label), kind, n_chapters. One text a
    question: a fact, a kind, a number of chapters, the note of an abstention, or none where evidence must be searched."""
    both = rows.join(facts, "entity_id", "left")
    structured = F.col("route") == "structured"
    answer = (
        F.when(F.col("route") == "abstain", F.concat(F.lit("No answer: "), "reason"))
        .when(structured & (F.col("intent") == "fact"), F.coalesce(F.element_at("labels", F.col("dim")), F.lit("not known")))
        .when(structured & (F.col("intent") == "kind"), F.col("kind"))
        .when(structured & (F.col("intent") == "appearance"), F.concat(F.coalesce("n_chapters", F.lit(0)).cast("string"), F.lit(" chapters")))
    )
    return both.withColumn("answer", answer)


def standings(values: DataFrame, members: int = 3) -> DataFrame:
    """values: entity_id, name, dim, value. dim, value, n, above, below, first: for each value of a dimension how many have
    it, more and less, and the names of the first ``members`` by id. Counts are added up before they meet; a row a value."""
    counts = values.where("value is not null").groupBy("dim", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("dim").orderBy("value")
    counts = counts.withColumn("_upto", F.sum("n").over(order)).withColumn("_all", F.sum("n").over(Window.partitionBy("dim")))
    nth = F.row_number().over(Window.partitionBy("dim", "value").orderBy("entity_id"))
    first = values.where("value is not null").withColumn("_n", nth).where(F.col("_n") <= members).groupBy("dim", "value").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "name"))), lambda x: x["name"]).alias("first"))
    return counts.join(first, ["dim", "value"]).select("dim", "value", "n", (F.col("_all") - F.col("_upto")).alias("above"), (F.col("_upto") - F.col("n")).alias("below"), "first")


def answered(rows: DataFrame, facts: DataFrame, values: DataFrame, evidence: DataFrame, level: Column) -> DataFrame:
    """rows of ``understood``; facts: entity_id, kind, owner, place, owned (names), n_owned, n_forms, n_moves, n_chapters;
    values: entity_id, name, dim, value (0 to 5), label; evidence: query_id, doc_id, the first found for open questions;
    ``level``: the level that a question names. Adds answer and source, what the answer was read from; where there is
    no answer, reason tells why. Of facts and values only those of the entities asked for meet the rows, which should be
    stored; every side's rows are counted before it is broadcast."""
    ranks = stored(standings(values), "standings")
    entities = stored(rows.where("entity_id is not null").select("entity_id").distinct(), "entities_asked")
    of_asked = lambda df, name: sized(stored(df.join(sized(entities), "entity_id", "left_semi"), name))
    facts, own = of_asked(facts, "facts_asked"), of_asked(values.select("entity_id", "dim", F.col("value").alias("_value"), "label"), "values_asked")
    at = ranks.select("dim", F.col("value").alias("_value"), "above", "below", F.col("n").alias("_like"))
    of_level = ranks.select("dim", F.col("value").alias("level"), F.col("n").alias("_n_level"), F.col("first").alias("_first_level"))
    ends = [ranks.groupBy("dim").agg(f(F.struct("n", "first"), "value").alias(name)) for f, name in ((F.max_by, "_top"), (F.min_by, "_bottom"))]
    both = rows.withColumn("level", level).join(facts, "entity_id", "left").join(own, ["entity_id", "dim"], "left").join(sized(at), ["dim", "_value"], "left").join(sized(of_level), ["dim", "level"], "left")
    for end in ends:
        both = both.join(sized(end), "dim", "left")
    both = both.join(sized(stored(evidence.select("query_id", "doc_id"), "evidence")), "query_id", "left")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    listed = lambda n, names: F.concat(n.cast("string"), F.lit(": "), F.array_join(names, "; "))
    low = F.col("rest").rlike(LOWEST)
    end = F.when(low, F.col("_bottom")).otherwise(F.col("_top"))
    known = F.col("entity_id").isNotNull()
    structured = {
        "fact": F.coalesce("label", F.when(known & F.col("dim").isNotNull(), F.lit("not known"))), "kind": F.col("kind"), "appearance": F.when(known, text(F.coalesce("n_chapters", F.lit(0)), " chapters")),
        "owner": F.col("owner"), "owned": F.when(known, listed(F.coalesce("n_owned", F.lit(0)), F.coalesce("owned", F.array().cast("array<string>")))), "forms": F.when(known, text(F.coalesce("n_forms", F.lit(0)), " forms")),
        "moves": F.when(known, text(F.coalesce("n_moves", F.lit(0)), " moves")), "compare": text(F.col("above"), " above, ", F.col("_like") - 1, " alike, ", F.col("below"), " below"),
        "count": text(F.coalesce("_n_level", F.when(F.col("dim").isNotNull() & F.col("level").isNotNull(), F.lit(0))), " entities"), "extreme": listed(end["n"], end["first"]), "list": listed(F.col("_n_level"), F.col("_first_level")),
    }
    by_intent = F.coalesce(*(F.when(F.col("intent") == name, answer) for name, answer in structured.items()))
    searched = F.col("route").isin("entity_semantic", "semantic", "hybrid")
    answer = F.when(F.col("route") == "structured", by_intent).when(F.col("route") == "location", F.col("place")).when(searched, text("document ", F.col("doc_id")))
    source = F.when(answer.isNotNull(), F.when(F.col("route") == "structured", "records").when(F.col("route") == "location", "places").otherwise("texts"))
    why = F.coalesce("reason", F.when(answer.isNull(), F.when(searched, "nothing found").when(F.col("route") == "character", "no record of persons").when((F.col("route") == "structured") & ~known & F.col("dim").isNull(), "no name and no dimension").otherwise("not on record")))
    return both.withColumn("answer", answer).withColumn("source", source).withColumn("reason", why)


def strip_lead_in(sentence: Column) -> Column:
    return F.regexp_replace(sentence, LEAD_IN, "")


def best_sentence(df: DataFrame, key: str, question: str, evidence: str) -> DataFrame:
    """The sentence of the evidence with most of the question's distinct words, the first of equals; none without one."""
    asked = F.array_distinct(words(F.col(question)))
    s = df.select(key, asked.alias("_q"), F.posexplode(sentences(F.col(evidence))).alias("place", "sentence"))
    scored = s.withColumn("n_common", F.size(F.array_intersect("_q", words(F.col("sentence"))))).where("n_common > 0")
    best = scored.groupBy(key).agg(F.max_by(F.struct("sentence", "place", "n_common"), F.struct("n_common", -F.col("place"))).alias("x"))
    return best.select(key, "x.sentence", "x.place", "x.n_common")


def assertions(answers: DataFrame, key: str, answer: str, dims: tuple[str, ...]) -> DataFrame:
    """key, dim, grade, negated for each 'power is A' or 'power is not A' of the answer."""
    pattern = rf"\b({'|'.join(dims)}) is (not )?([A-E])\b"
    found = F.regexp_extract_all(F.col(answer), F.lit(pattern), F.lit(0))
    one = answers.select(key, F.explode(found).alias("_a"))
    return one.select(key, F.regexp_extract("_a", pattern, 1).alias("dim"), F.regexp_extract("_a", pattern, 3).alias("grade"), (F.regexp_extract("_a", pattern, 2) != "").alias("negated"))


def checked(said: DataFrame, key: str, truth: DataFrame) -> DataFrame:
    """said of ``assertions``; truth: key, dim, label. Per key: assertions, those that hold, those that contradict, and
    the share that holds among what can be told; null where nothing can be."""
    parts = parts_of(truth, CELLS_A_TASK)
    held = truth.repartition(parts, key).groupBy(key).agg(F.collect_list(F.struct("dim", "label")).alias("_t"))
    met = said.repartition(parts, key).join(held, key, "left")
    met = met.withColumn("label", F.explode_outer(F.transform(F.filter("_t", lambda t: t["dim"] == F.col("dim")), lambda t: t["label"])))
    same = F.col("label") == F.col("grade")
    holds = F.when(F.col("label").isNotNull(), F.when(F.col("negated"), ~same).otherwise(same))
    out = met.groupBy(key).agg(F.count("*").alias("n_said"), F.count_if(holds).alias("n_held"), F.count_if(~holds).alias("n_contradicted"))
    told_of = F.col("n_held") + F.col("n_contradicted")
    return out.withColumn("share", F.when(told_of > 0, F.round(F.col("n_held") / told_of, 4)))


def foreign_names(answer: Column, evidence: Column) -> Column:
    """Names of the answer that the evidence has not."""
    return F.array_except(said_names(answer), said_names(evidence))
