"""One name an entity and its variants, out of sources that contradict one another.

A name is decided in levels, and each step is a join against what the steps before have fixed: a forced name stands
above the official one, that above a fetched one, that above additions by hand. Variants then give way to owners of the
name, and what several entities still share names none of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.sources.storage import stored
from loomspark.sources.tables import sized

# Forms of characters that are Japanese, or old ones, and tell that a name is not written in simple ones.
OTHER_FORMS = "験體経驗壓気館髮"


def is_usable(name: Column) -> Column:
    """Two Han characters or more: names of one would be met everywhere."""
    return F.coalesce(F.regexp_count(name, F.lit("[一-鿿]")) >= 2, F.lit(False))


def has_other_forms(name: Column) -> Column:
    return F.coalesce(name.rlike(f"[{OTHER_FORMS}]"), F.lit(False))


def arbitrated(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sources: entity_id, source ('forced', 'official', 'fetched' or 'added'), place (order within the source), name.
    (names: entity_id, name, level (A official, B forced, C others), source, rejected; variants: entity_id, name).

    1. The name: the forced one; else the official one, unless it has other forms and a fetched or added one is there,
       which then stands for it; else the first fetched, else the first added one. A name that is not usable gives way
       to the first usable added one, and is kept as rejected; without one the entity has no name and no variants.
    2. Variants: the other fetched and added ones, and the name that a forced one has replaced.
    3. A variant that is another entity's name, and not its own, yields to that owner.
    4. What two or more entities still have, as name or variant, is dropped from all variants, but stays with the
       entity whose name a forced one has replaced.
    An entity's other names stay in its row until its name is known, so entities are dealt out once and meet no table of
    entities; what is told of a name (owned, shared) has a row a name. Nulls and repeated rows change nothing. The names of two entities may be equal: names are not taken away."""
    given = sources.where("entity_id is not null and name is not null").groupBy("entity_id", "source", "name").agg(F.min("place").alias("place"))
    first = lambda source: F.min_by(F.when(F.col("source") == source, F.col("name")), F.when(F.col("source") == source, F.struct("place", "name"))).alias(source)
    usable_added = (F.col("source") == "added") & is_usable(F.col("name"))
    firsts = given.groupBy("entity_id").agg(*map(first, ("forced", "official", "fetched", "added")), F.min_by(F.when(usable_added, F.col("name")), F.when(usable_added, F.struct("place", "name"))).alias("usable"), F.collect_set(F.when(F.col("source").isin("fetched", "added"), F.col("name"))).alias("others"))
    plain = F.coalesce("fetched", "added")
    automatic = F.when(has_other_forms(F.col("official")) & plain.isNotNull(), plain).otherwise(F.coalesce("official", plain))
    before = F.coalesce("official", plain)
    source = F.when(F.col("forced").isNotNull(), "forced").when(F.col("official").isNotNull() & (automatic == F.col("official")), "official").when(F.col("fetched").isNotNull(), "fetched").otherwise("added")
    chosen = firsts.select("entity_id", F.coalesce("forced", automatic).alias("chosen"), source.alias("source"), "usable", "others", F.when(F.col("forced").isNotNull() & (before != F.col("forced")), before).alias("replaced"))
    fits = is_usable(F.col("chosen"))
    names = chosen.select("entity_id", F.when(fits, F.col("chosen")).otherwise(F.col("usable")).alias("name"), F.when(fits, F.col("source")).otherwise("added").alias("source"), F.when(~fits, F.col("chosen")).alias("rejected"), "replaced", "others").where("name is not null")
    level = F.when(F.col("source") == "official", "A").when(F.col("source") == "forced", "B").otherwise("C")
    names = stored(names.withColumn("level", level), "names_decided")
    every = F.array_union("others", F.when(F.col("replaced").isNotNull(), F.array("replaced")).otherwise(F.array().cast("array<string>")))
    others = names.select("entity_id", F.col("name").alias("own"), "replaced", F.explode(every).alias("name")).where("name <> own")
    # 3: one's own name is no variant, so every owner is another
    said = names.select("name", F.lit(1).alias("owned"), F.lit(0).alias("n")).unionByName(others.select("name", F.lit(0).alias("owned"), F.lit(1).alias("n")))
    free = stored(said.groupBy("name").agg(F.max("owned").alias("owned"), F.sum("n").alias("n")).where("owned = 0").select("name", (F.col("n") > 1).alias("shared")), "names_free")
    # 4
    left = others.join(sized(free), "name").where("not shared or name = replaced")
    return names.select("entity_id", "name", "level", "source", "rejected"), left.select("entity_id", "name")


def shared_names(names: DataFrame) -> DataFrame:
    """Names of several entities: name, n, first (the least id)."""
    return names.groupBy("name").agg(F.count("*").alias("n"), F.min("entity_id").alias("first")).where("n > 1")


def name_table(names: DataFrame, variants: DataFrame) -> DataFrame:
    """alias, entity_id: one entity an alias; of entities with one name the least."""
    both = names.select(F.col("name").alias("alias"), "entity_id", F.lit(0).alias("p")).unionByName(variants.select(F.col("name").alias("alias"), "entity_id", F.lit(1).alias("p")))
    order = Window.partitionBy("alias").orderBy("p", "entity_id")
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("alias", "entity_id")
