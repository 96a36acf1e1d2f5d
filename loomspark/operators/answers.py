"""Answers about entities: cards, lists, cascades of name matches, related things, and what is missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(df: DataFrame, keys: list[str], n: int, *order: Column, position: str = "position") -> DataFrame:
    """The first n rows of each key with their position from 1; Spark limits in each task before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(position, F.row_number().over(w)).where(F.col(position) <= n)


def missing_fields(fields: dict[str, Column]) -> Column:
    """Names of the fields that are null or blank, in order."""
    return F.filter(F.array(*(F.when(F.coalesce(F.trim(c.cast("string")), F.lit("")) == "", F.lit(name)) for name, c in fields.items())), lambda x: x.isNotNull())


def cascade(asked: DataFrame, ways: list[DataFrame], limit: int = 8) -> DataFrame:
    """asked: query_id, term. Each way: term, entity_id; earlier ways count before later ones. Per question the
    candidates of the first way that has any: their number (all of them), the lowest ``limit`` ids, the way, and
    the one entity, which is null where there are several: nothing is picked among equals. A question without a
    candidate has outcome 'none'."""
    tried = reduce(DataFrame.unionByName, (w.select("term", "entity_id", F.lit(i).alias("way")) for i, w in enumerate(ways)))
    met = asked.select("query_id", "term").join(tried, "term").select("query_id", "way", "entity_id").distinct()
    counted = met.groupBy("query_id", "way").agg(F.count("*").alias("n_candidates"), F.min("entity_id").alias("entity_id"))
    best = first_per(counted, ["query_id"], 1, F.col("way")).drop("position")
    held = met.join(best.select("query_id", "way"), ["query_id", "way"])
    ids = first_per(held, ["query_id"], limit, F.col("entity_id")).groupBy("query_id").agg(F.array_sort(F.collect_list("entity_id")).alias("candidates"))
    out = asked.select("query_id", "term").join(best.join(ids, "query_id"), "query_id", "left")
    n = F.coalesce(F.col("n_candidates"), F.lit(0))
    outcome = F.when(n == 0, "none").when(n == 1, "one").otherwise("ambiguous")
    return out.select("query_id", "term", "way", n.alias("n_candidates"), "candidates", F.when(n == 1, F.col("entity_id")).alias("entity_id"), outcome.alias("outcome"))


def related(edges: DataFrame, owner: str, entity: str, strong: Column) -> DataFrame:
    """Per owner and entity one row, strong if any edge is."""
    return edges.groupBy(owner, entity).agg(F.max(strong.cast("int")).alias("strong"), F.count("*").alias("n_edges"))


def off_scale_notes(cells: DataFrame) -> DataFrame:
    """Per dimension: cells with a value, infinite ones and conditional ones, the caveats of an extreme."""
    return cells.groupBy("dim").agg(
        F.count("value").alias("n_valued"), F.count_if(F.col("category") == "INFINITE").alias("n_infinite"),
        F.count_if(F.col("category").isin("CONDITIONAL", "CONDITIONAL_NO_BASE")).alias("n_conditional"),
    )


def preferred(curated: Column, inferred: Column) -> Column:
    """struct(value, note): the curated value where there is one; a note where both are there and differ."""
    differ = curated.isNotNull() & inferred.isNotNull() & (curated != inferred)
    return F.struct(F.coalesce(curated, inferred).alias("value"), F.when(differ, F.concat(F.lit("inferred "), inferred.cast("string"), F.lit(", curated "), curated.cast("string"))).alias("note"))


def answer_flags(answer: Column, markers: list[str], short: int = 40) -> Column:
    """struct(hedged, empty): a short answer with a marker says that nothing is known."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    marked = reduce(lambda a, b: a | b, (F.contains(low, F.lit(m)) for m in markers))
    return F.struct((marked & (F.length(low) < short)).alias("hedged"), (F.trim(low) == "").alias("empty"))
