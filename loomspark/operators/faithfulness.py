"""Whether the numbers of an answer stand in its evidence: values by dimension, in windows behind the dimension's name.

Evidence is cut into words once; a value belongs to the nearest name of a dimension before it, if no more than ``gap``
words stand between, so the value of one dimension is never lent to the next. Answers state or deny a dimension's grade
or number, or count things. What is said meets what stands by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import let
from loomspark.sources.tables import parts_of

#: Texts of either side that a task takes; each has its words in memory.
TEXTS_A_TASK = 20_000

# Names of the dimensions in answers and in evidence.
SAID = {
    "power": ("破坏力", "力量", "威力", "destructive power", "power"), "speed": ("速度", "speed"), "range": ("射程", "范围", "距离", "range"),
    "stamina": ("持续力", "耐久", "持久", "stamina", "durability"), "precision": ("精密性", "精度", "precision"), "potential": ("成长性", "成长", "potential", "growth"),
}
WRITTEN = {
    "power": ("destructive", "power", "pwr"), "speed": ("speed", "spd"), "range": ("range", "rng"), "stamina": ("stamina", "sta", "durability", "persistence"),
    "precision": ("precision", "prc"), "potential": ("growth", "dev", "development"),
}
DENIALS, STATEMENTS = ("并不是", "不是", "不为", "is not", "isn't"), ("定为", "是", "为", "is", "＝", "=", "：", ":")
GRADING = ("等级", "评级", "级别", "level", "grade", "rating")
COUNTED = ("个", "位", "名", "条", "种", "parts", "entities", "items", "forms", "moves")
GRADES = "ABCDE"

_NAMES = "|".join(sorted((n for names in SAID.values() for n in names), key=len, reverse=True))
_VALUE = r"[A-E](?![A-Za-z])|[0-9]+(?:[.][0-9]+)?|∞|无|未知|none|unknown"
#: name, grading word, denial or statement, value, grading word behind it
_SAYING = rf"(?i:({_NAMES}))\s*((?i:{'|'.join(GRADING)}))?\s*((?i:{'|'.join((*DENIALS, *STATEMENTS))}))\s*(?:定为\s*)?({_VALUE})(\s*级|\s*(?i:level))?"
#: A number behind a colon that opens a list is no value.
_LISTING = r"[:：]\s*[0-9]+[.、）)]"
_COUNTING = rf"([0-9]+)\s*(?:{'|'.join(COUNTED)})"


def _canonical(name: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """The dimension of a name; a look-up in a literal map."""
    pairs = [F.lit(x) for dim, names in table.items() for n in names for x in (n, dim)]
    return F.try_element_at(F.create_map(*pairs), F.lower(name))


def written_values(evidence: DataFrame, key: str, text: str, gap: int = 4) -> DataFrame:
    """key, dim (null: of no dimension), kind ('grade' or 'number'), value: the distinct grades A to E and numbers of each
    text. A grade is a letter standing alone, of either case."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[a-z][a-z0-9'’]*|[0-9]+(?:[.][0-9]+)?"), F.lit(0))

    def values(x: Column) -> Column:
        def value(w: Column, i: Column) -> Column:
            kind = F.when(w.rlike("^[a-e]$"), "grade").when(w.rlike("^[0-9]"), "number")
            before = F.slice(x["named"], F.greatest(i - gap - 1, F.lit(0)) + 1, F.least(i, F.lit(gap + 1)) + 1)
            near = F.when(kind.isNotNull(), F.try_element_at(F.filter(before, lambda n: n.isNotNull()), F.lit(-1)))
            return F.struct(near.alias("dim"), kind.alias("kind"), F.upper(w).alias("value"))

        return F.array_distinct(F.filter(F.transform(x["words"], value), lambda v: v["kind"].isNotNull()))

    named = let(words, lambda ws: F.struct(ws.alias("words"), F.transform(ws, lambda w: _canonical(w, WRITTEN)).alias("named")))
    return evidence.where(F.col(key).isNotNull()).select(key, F.explode(let(named, values)).alias("v")).select(key, "v.*").distinct()


def said_values(answers: DataFrame, key: str, answer: str) -> DataFrame:
    """key, nth, dim (null: a count), kind ('grade', 'number', 'count' or 'word'), value, denied: what an answer says, in
    order. Levels 0 to 5 are grades where a grading word stands beside them, numbers elsewhere; level 5 is A."""
    text = F.coalesce(F.col(answer), F.lit(""))
    said = F.filter(F.regexp_extract_all(text, F.lit(_SAYING + r"(?:\s*[.、）)])?"), F.lit(0)), lambda s: ~s.rlike(_LISTING))
    rows = answers.where(F.col(key).isNotNull()).select(key, F.posexplode(said).alias("nth", "s"))
    part = lambda i: F.regexp_extract("s", _SAYING, i)
    value, graded = F.upper(part(4)), (part(2) != "") | (part(5) != "")
    level = value.rlike("^[0-5]$") & graded
    letter = F.when(level & (value != "0"), F.substring(F.lit(GRADES), F.lit(6) - value.cast("int"), F.lit(1))).otherwise(value)
    kind = F.when(value.rlike("^[A-E]$") | level, "grade").when(value.rlike("^[0-9]"), "number").otherwise("word")
    stated = rows.select(key, "nth", _canonical(part(1), SAID).alias("dim"), kind.alias("kind"), F.when(level, letter).otherwise(value).alias("value"), F.lower(part(3)).isin(*DENIALS).alias("denied"))
    counted = answers.where(F.col(key).isNotNull()).select(key, F.posexplode(F.regexp_extract_all(text, F.lit(_COUNTING), F.lit(1))).alias("nth", "value"))
    return stated.unionByName(counted.select(key, (F.col("nth") + 1_000_000).alias("nth"), F.lit(None).cast("string").alias("dim"), F.lit("count").alias("kind"), "value", F.lit(False).alias("denied")))


def judged(said: DataFrame, written: DataFrame, key: str) -> DataFrame:
    """said of ``said_values`` with supported: a grade must stand by its dimension; a number by its dimension, or anywhere
    where the evidence has no number by that dimension; a count anywhere; a denial holds where the value does not."""
    rows = said.join(written.groupBy(key).agg(F.collect_set(F.struct("dim", "kind", "value")).alias("_w")), key, "left")
    has = lambda test: F.coalesce(F.exists("_w", test), F.lit(False))
    near = has(lambda w: (w["dim"] == F.col("dim")) & (w["kind"] == F.col("kind")) & (w["value"] == F.col("value")))
    numbers, found = has(lambda w: (w["dim"] == F.col("dim")) & (w["kind"] == "number")), has(lambda w: (w["kind"] == "number") & (w["value"] == F.col("value")))
    stands = F.when(F.col("kind") == "grade", near).when(F.col("kind") == "number", F.when(numbers, near).otherwise(found)).when(F.col("kind") == "count", found).otherwise(F.lit(False))
    return rows.select(key, "nth", "dim", "kind", "value", "denied", (stands != F.col("denied")).alias("supported"))


def numeric_shares(answers: DataFrame, evidence: DataFrame, key: str, answer: str, text: str) -> DataFrame:
    """A row for each answer: key, n_said, n_supported, share (null where nothing is said). All steps stay in the tasks that
    own the keys, of which there are as many as the rows of either side ask for."""
    parts = max(parts_of(answers, TEXTS_A_TASK), parts_of(evidence, TEXTS_A_TASK))
    answers, evidence = answers.repartition(parts, key), evidence.repartition(parts, key)
    rows = judged(said_values(answers, key, answer), written_values(evidence, key, text), key)
    counts = rows.groupBy(key).agg(F.count("*").alias("n_said"), F.count_if("supported").alias("n_supported"))
    out = answers.select(key).join(counts, key, "left")
    n, ok = F.coalesce("n_said", F.lit(0)), F.coalesce("n_supported", F.lit(0))
    return out.select(key, n.alias("n_said"), ok.alias("n_supported"), F.when(n > 0, F.round(ok / n, 4)).alias("share"))
