"""Building chunks and records from pages: typed page chunks, article chunks, global numbers, records with reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions import markup
from loomspark.functions.parsing import is_noise_heading
from loomspark.functions.text import clean_text
from loomspark.operators.chunking import keep_first
from loomspark.operators.numbering import gapless_ids

#: Characters of a chunk, at least.
LEAST = 80
# Words by which a paragraph is lore; how list items of no value begin, or what they hold; chapter items.
LORE_WORDS = ("named after", "tarot", "card", "deity", "mytholog", "namesake", "based on", "reference to")
NOISE_STARTS, NOISE_PARTS, NOISE_ITEMS = ("retrieved from", "[", "jump to", "privacy policy"), ("manga▾", "parts▸", "categories:"), ("edit",)


def has_any(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in parts))


def is_chapter_item(text: Column) -> Column:
    """'Chapter 12: ...', with a title of letters before it, or an episode's number anywhere."""
    return text.rlike(r"(?i)^[a-z ]*\bchapter\s[0-9]+\s*:") | text.rlike(r"(?i)\bepisode\s[0-9]+")


def is_noise_item(text: Column) -> Column:
    """Blank items, numbered contents, and what a wiki's pages say about themselves; chapter items are none."""
    low = F.lower(text)
    starts = reduce(lambda a, b: a | b, (F.startswith(low, F.lit(p)) for p in NOISE_STARTS))
    noise = (F.trim(text) == "") | low.rlike(r"^[0-9]+([.][0-9]+)*\s") | starts | has_any(low, NOISE_PARTS) | low.isin(*NOISE_ITEMS) | low.rlike(r"\bcookie\b")
    return F.coalesce(noise & ~is_chapter_item(text), F.lit(True))


def _chunk(kind: Column | str, content: Column, section: Column | str, entity: Column | str = "") -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(as_column(kind).alias("chunk_type"), clean_text(F.coalesce(content, F.lit(""))).alias("content"), F.coalesce(as_column(section), F.lit("")).alias("section"), F.coalesce(as_column(entity), F.lit("")).alias("entity"))



def page_chunks(pages: DataFrame, owner: str, least: int = LEAST) -> DataFrame:
    """pages: owner, overview array<string>, sections array<struct<heading, paras, lists>>, moves array<struct<name, text,
    section>>, battles array<string>, lore array<string>; each may be null. owner, pos, chunk_type, content, section,
    entity: the chunks of a page in order, cleaned, of ``least`` characters or more, of equal type and content the first.
    Sections under headings of no value are left out, as are list items but for chapters. Rows of one owner are one page."""
    def of_section(s: Column) -> Column:
        paras = F.transform(F.coalesce(s["paras"], F.array().cast("array<string>")), lambda p: _chunk(F.when(has_any(F.lower(p), LORE_WORDS), "lore").otherwise("section"), p, s["heading"]))
        items = F.filter(F.flatten(F.filter(F.coalesce(s["lists"], F.array().cast("array<array<string>>")), lambda x: x.isNotNull())), lambda i: is_chapter_item(i) & ~is_noise_item(i))
        return F.concat(paras, F.transform(items, lambda i: _chunk("battle_record", i, s["heading"])))

    kind = "array<struct<chunk_type:string,content:string,section:string,entity:string>>"
    none = F.expr(f"from_json('[]', '{kind}')")
    useful = F.filter("sections", lambda s: (F.coalesce(F.trim(s["heading"]), F.lit("")) != "") & ~is_noise_heading(s["heading"]))
    moves = F.filter("moves", lambda m: F.coalesce(F.trim(m["name"]), F.lit("")) != "")
    parts = [
        F.transform("overview", lambda p: _chunk("ability_overview", p, "(overview)")),
        F.flatten(F.transform(useful, of_section)),
        F.transform(moves, lambda m: _chunk("move", F.when(F.coalesce(m["text"], F.lit("")) != "", m["text"]).otherwise(m["name"]), F.coalesce(m["section"], F.lit("TECHNIQUES")), F.trim(m["name"]))),
        F.transform("battles", lambda b: _chunk("battle_record", b, "CHAPTERS")),
        F.transform("lore", lambda x: _chunk("lore", x, "(lore)")),
    ]
    every = F.filter(F.concat(*(F.coalesce(p.cast(kind), none) for p in parts)), lambda c: F.length(c["content"]) >= least)
    rows = pages.select(owner, F.posexplode(every).alias("pos", "c")).select(owner, "pos", "c.chunk_type", "c.content", "c.section", "c.entity")
    return keep_first(rows, owner, "chunk_type", "content")


def numbered_chunks(chunks: DataFrame, owner: str, first: int = 1) -> DataFrame:
    """chunks with chunk_id, without a gap over the cluster, in the order of owner and pos."""
    return gapless_ids(chunks, [owner, "pos"], "chunk_id", first)


def section_blocks(articles: DataFrame, *keys: str, least: int = 200, most: int = 900) -> DataFrame:
    """articles: keys, text (washed). keys, pos, section, content: the blocks of ``markup.sections``."""
    cut = markup.arrow(lambda t: markup.sections(t, least, most), markup.SECTIONS)
    return articles.select(*keys, F.posexplode(cut("text")).alias("pos", "b")).select(*keys, "pos", "b.section", "b.content")


def article_chunks(articles: DataFrame, owner: str, kind: str, base: DataFrame, least: int = LEAST) -> DataFrame:
    """articles: owner, kind (stand, character, location or arc), included (places only: whether it counts), wikitext.
    base: chunks that are there already, with chunk_id. The articles' blocks of ``least`` characters or more, numbered
    behind those of base; the owner stands in the column of its kind alone."""
    counts = (F.col(kind) != "location") | F.coalesce(F.col("included"), F.lit(False))
    wash = markup.arrow(markup.washed, "string")
    texts = articles.where(counts & F.col(kind).isNotNull()).select(owner, kind, wash("wikitext").alias("text"))
    blocks = section_blocks(texts, owner, kind).withColumn("content", F.trim("content")).where(F.length("content") >= least)
    top = base.agg(F.coalesce(F.max("chunk_id"), F.lit(0)).alias("m")).first()[0]
    out = gapless_ids(blocks, [kind, owner, "pos"], "chunk_id", top + 1)
    owners = [F.when(F.col(kind) == k, F.col(owner)).alias(f"{k}_id") for k in ("stand", "character", "location", "arc")]
    section = F.when(F.col("section") == "", "(lead)").otherwise(F.col("section")).alias("section")
    return out.select("chunk_id", *owners, F.lit("article_section").alias("chunk_type"), section, "content", F.length("content").alias("content_len"))


def built_records(pages: DataFrame, key: str, rules: list[tuple[str, Column]], built: dict[str, Column], same: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, left out). ``rules`` are reasons with their conditions, in order: a page of which none holds is a record
    with the columns of ``built``; any other is left out for the first that holds. With ``same``, a column of ``built``,
    only the page of the least key becomes a record, others of that value are left out as 'duplicate'. Each page is in
    exactly one of the two."""
    reason = F.coalesce(*[F.when(F.coalesce(condition, F.lit(False)), F.lit(name)) for name, condition in rules], F.lit(None).cast("string"))
    rows = pages.withColumn("reason", reason).withColumns(built)
    if same:
        order = Window.partitionBy(same, F.col("reason").isNull()).orderBy(key)
        again = F.col("reason").isNull() & F.col(same).isNotNull() & (F.row_number().over(order) > 1)
        rows = rows.withColumn("reason", F.when(again, F.lit("duplicate")).otherwise(F.col("reason")))
    return rows.where("reason is null").select(key, *built), rows.where("reason is not null").select(key, "reason")
