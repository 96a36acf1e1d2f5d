"""Text expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that carry no meaning in retrieval.
STOPWORDS = (
    "a an the of and or to in on at for with by from is are was were be been being this that these those it its as but if then than so such not no nor do does did have has had can could will would shall should may might must "
    "i you he she they we me him her them my your his their our what which who whom whose when where why how all any both each few more most other some only own same too very"
).split()


@F.pandas_udf(StringType())
def nfkc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode compatibility composition; no built-in does it, so texts that may need it pass here in Arrow batches."""
    import unicodedata

    for s in texts:
        yield s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often a lambda in body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def latin_tokens(text: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """Lower-case words of two or more letters or digits that are no stopwords, in order, repeats kept."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]{2,}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(stopwords))


def cjk_tokens(text: Column) -> Column:
    """Every Han character, then the bigrams of the characters run together (gaps between them do not count)."""
    chars = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[一-鿿]"), F.lit(0))
    none = F.array().cast("array<string>")
    return let(chars, lambda c: F.concat(c, F.when(F.size(c) > 1, F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.concat(F.element_at(c, i), F.element_at(c, i + 1)))).otherwise(none)))


def tokens(text: Column) -> Column:
    return F.concat(latin_tokens(text), cjk_tokens(text))


def words(text: Column) -> Column:
    """All lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def word_string(text: Column) -> Column:
    return F.array_join(words(text), " ")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\r\n\f\x0B]+", " "))


def padded(text: Column) -> Column:
    """The squeezed lower-case text between two spaces on either side."""
    return F.concat(F.lit("  "), F.lower(squeeze(text)), F.lit("  "))


def char_grams(text: Column, n: int = 3) -> Column:
    """Character n-grams of the padded text; each is a substring by place, so for short texts only."""
    return let(padded(text), lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - (n - 1)), lambda i: F.substring(p, i, n)))


def sentences(text: Column) -> Column:
    """Cut behind . ! ? where white space and a capital or bracket follow, and behind full-width stops."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), "([。！？；])\\s*", "$1\u0001")
    marked = F.regexp_replace(marked, "([.!?])\\s+([A-Z(])", "$1\u0001$2")
    return F.filter(F.transform(F.split(marked, "\u0001"), F.trim), lambda s: F.length(s) >= 2)


def slug(name: Column) -> Column:
    """Lower case, anything but letters and digits as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def bounded_slug(name: Column, limit: int = 48) -> Column:
    """A slug of at most ``limit`` characters; longer ones keep their start and a hash of the name."""
    s = slug(name)
    return F.when(F.length(s) > limit, F.concat(F.substring(s, 1, limit - 9), F.lit("_"), F.substring(F.sha1(name), 1, 8))).otherwise(s)


def count_of(text: Column, part: Column) -> Column:
    """How often part stands in text, not overlapping."""
    return F.floor((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")


def answer_form(text: Column) -> Column:
    """The form in which answers are compared: lower case, quotes and punctuation gone, single spaces."""
    t = F.lower(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(t, "[\"'“”‘’「」『』`]", "")
    return squeeze(F.regexp_replace(t, "[^\\p{L}\\p{N}_\\s]", " "))


def clean_text(text: Column) -> Column:
    """Footnote marks such as [12] or [a] go, white space is squeezed."""
    return squeeze(F.regexp_replace(text, r"\[[0-9a-z]{1,3}\]", ""))


def html_to_text(html: Column) -> Column:
    """Ordered rewrites of simple markup: head, scripts, styles and comments go, headings become '## ' lines, blocks lines."""
    t = F.regexp_replace(html, r"(?is)<(head|script|style|nav|footer)\b.*?(</\1>|\z)", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<h[1-6][^>]*>", "\n## ")
    t = F.regexp_replace(t, r"(?i)</?(p|div|br|li|ul|ol|tr|table|section|article|h[1-6])\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    lines = F.transform(F.split(t, "\n"), lambda s: squeeze(s))
    return F.array_join(F.filter(lines, lambda s: (s != "") & (s != "##")), "\n")
