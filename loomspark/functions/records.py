"""Parsing of record fields: names, numbers, appearances, origins, relatives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.functions.text import let, squeeze

# Chapters before each part when parts are counted through, and the first and last of each.
CHAPTER_OFFSETS = {1: 0, 2: 44, 3: 113, 4: 265, 5: 439}
CHAPTER_BOUNDS = {1: (1, 44), 2: (45, 113), 3: (114, 265), 4: (266, 439), 5: (440, 594), 6: (595, 752)}
HAN_NUMBERS = "一二三四五六七八九"
# Words of kinship by base and age; longer bases first, so that grandfather is no father.
KIN = {
    "grandfather": "grandfather", "grandmother": "grandmother", "grandson": "grandson", "granddaughter": "granddaughter", "great-uncle": "uncle", "father": "father", "mother": "mother",
    "brother": "brother", "sister": "sister", "uncle": "uncle", "aunt": "aunt", "cousin": "cousin", "nephew": "nephew", "niece": "niece", "son": "son", "daughter": "daughter", "husband": "husband", "wife": "wife",
}


def name_key(name: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def sorted_name_key(name: Column) -> Column:
    """The lower-case words in order of the alphabet."""
    return F.array_join(F.array_sort(F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda w: w != "")), " ")


def part_number(text: Column) -> Column:
    """Digits or Han numerals up to ten as a number."""
    digits = F.regexp_extract(text, "([0-9]+)", 1)
    han = F.regexp_extract(text, f"([{HAN_NUMBERS}十])", 1)
    return F.when(digits != "", digits.cast("int")).when(han == "十", 10).when(han != "", F.instr(F.lit(HAN_NUMBERS), han))


def split_names(names: Column) -> Column:
    """Names between commas, semicolons or slashes, or glued ones at a small letter before a capital, except
    behind Mc and Mac. A split that leaves a fragment of two letters or over six names is taken back. Counts in brackets go."""
    plain = squeeze(F.regexp_replace(names, r"\s*\([0-9]+\)", ""))
    listed = F.filter(F.transform(F.split(plain, r"\s*[,;/]\s*"), F.trim), lambda n: n != "")
    marked = F.regexp_replace(F.regexp_replace(plain, r"(Mc|Mac)([A-Z])", "$1\u0002$2"), "([a-z])([A-Z])", "$1\u0001$2")
    glued = F.transform(F.split(marked, "\u0001"), lambda n: F.replace(n, F.lit("\u0002"), F.lit("")))
    return F.when(plain.rlike("[,;/]"), listed).otherwise(let(glued, lambda g: F.when((F.size(g) > 6) | F.exists(g, lambda n: F.length(n) <= 2), F.array(plain)).otherwise(g)))


def split_kinds(text: Column, vocabulary: list[str]) -> Column:
    """struct(kinds, rest): terms of a closed vocabulary in order, the longest at each place, and what is none."""
    terms = "|".join(t.replace("-", r"\-") for t in sorted(vocabulary, key=lambda t: (-len(t), t)))
    return F.struct(F.regexp_extract_all(text, F.lit(f"({terms})"), F.lit(1)).alias("kinds"), squeeze(F.regexp_replace(text, terms, " ")).alias("rest"))


def appearance(text: Column) -> Column:
    """struct(kind, chapter, episode, title). A cover is a cover whatever else it says."""
    chapter, episode = F.regexp_extract(text, r"(?i)chapter ([0-9]+)", 1), F.regexp_extract(text, r"(?i)episode ([0-9.]+[0-9]|[0-9])", 1)
    title = F.regexp_replace(F.regexp_extract(text, r"^[^:]*:\s*(.*)$", 1), r"(\s*\([^)]*\))*$", "")
    kind = F.when(text.rlike(r"(?i)\bcover\b"), "cover").when(episode != "", "anime").when(chapter != "", "manga").otherwise("other")
    return F.struct(kind.alias("kind"), F.when(chapter != "", chapter.cast("int")).alias("chapter"), F.when(episode != "", episode).alias("episode"), F.when(title != "", title).alias("title"))


def absolute_chapter(part: Column, relative: Column) -> Column:
    """Chapters counted through all parts; null for parts that are counted by themselves."""
    out = None
    for p, before in CHAPTER_OFFSETS.items():
        out = F.when(part == p, relative + before) if out is None else out.when(part == p, relative + before)
    return out


def part_of_chapter(chapter: Column) -> Column:
    out = None
    for p, (low, high) in CHAPTER_BOUNDS.items():
        hit = chapter.between(low, high)
        out = F.when(hit, p) if out is None else out.when(hit, p)
    return out


def canonical(names: Column, redirects: dict[str, str]) -> Column:
    """Each of the comma-separated names by its redirect, or as it is."""
    if not redirects:
        return names
    table = F.create_map(*(F.lit(x) for pair in redirects.items() for x in pair))
    return F.array_join(F.transform(F.split(names, r"\s*,\s*"), lambda n: F.coalesce(F.element_at(table, n), n)), ", ")


def spelling_variants(name: Column) -> Column:
    """Spellings of a name that ends in ACT and a number: three cases, four spacings; the name alone otherwise."""
    base, number = F.regexp_extract(name, r"(?i)^(.*?)[ :_-]*act[ :_-]*[0-9]+$", 1), F.regexp_extract(name, r"(?i)act[ :_-]*([0-9]+)$", 1)
    variants = [F.concat(base, F.lit(" "), F.lit(word), F.lit(gap), number) for word in ("ACT", "Act", "act") for gap in ("", " ", "-", ":")]
    return F.when(number != "", F.array_distinct(F.array(*variants))).otherwise(F.array(name))


def relative(entry: Column) -> Column:
    """struct(name, role, base, age) of 'Name (Younger Sister)'; base is the longest kinship word in the role."""
    role = F.regexp_extract(entry, r"\(([^)]*)\)\s*$", 1)
    low, base = F.lower(role), None
    for word in sorted(KIN, key=lambda w: (-len(w), w)):
        base = F.when(low.contains(word), KIN[word]) if base is None else base.when(low.contains(word), KIN[word])
    age = F.when(low.rlike("younger|little"), "younger").when(low.rlike("older|elder|big"), "older")
    return F.struct(F.trim(F.regexp_replace(entry, r"\([^)]*\)\s*$", "")).alias("name"), F.when(role != "", role).alias("role"), base.alias("base"), age.alias("age"))


def relative_match(found: Column, base: str, age: str | None) -> Column:
    """exact, loose (the age is not told) or contrast (the other age) for who is asked for; null for other kin."""
    same = found["base"] == base
    if age is None:
        return F.when(same, "exact")
    return F.when(same & (found["age"] == age), "exact").when(same & found["age"].isNull(), "loose").when(same, "contrast")
