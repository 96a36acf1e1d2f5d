"""Parsing of record fields."""

import pytest
from pyspark.sql import functions as F

from loomspark.functions import records as N


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "names"),
    [("Ann (1), Bob (2)", ["Ann", "Bob"]), ("Thunder McQueen", ["Thunder McQueen"]), ("AnnaBella", ["Anna", "Bella"]), ("Ann/Bob; Cid", ["Ann", "Bob", "Cid"]), ("RoboX", ["RoboX"])],
)
def test_split_names(spark, text, names):
    assert one(spark, N.split_names(F.col("t")), text) == names


def test_split_kinds_takes_the_longest(spark):
    x = one(spark, N.split_kinds(F.col("t"), ["Humanoid", "Natural Non-Humanoid", "Natural"]), "Natural Non-HumanoidNatural odd")
    assert (x.kinds, x.rest) == (["Natural Non-Humanoid", "Natural"], "odd")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Chapter 114: Two Men, Part 1", ("manga", 114, None, "Two Men, Part 1")), ("Golden Episode 13.5: Rest", ("anime", None, "13.5", "Rest")),
        ("Chapter 1 Cover", ("cover", 1, None, None)), ("Lands Chapter 1: Departure (Cover only)", ("cover", 1, None, "Departure")),
    ],
)
def test_appearance(spark, text, want):
    assert tuple(one(spark, N.appearance(F.col("t")), text)) == want


def test_numbers_and_redirects(spark):
    assert [one(spark, N.part_number(F.col("t")), t) for t in ("part 8", "第八部", "十", "none")] == [8, 8, 10, None]
    assert one(spark, N.canonical(F.col("t"), {"A": "Z"}), "A, B") == "Z, B"
    assert len(one(spark, N.spelling_variants(F.col("t")), "Echo ACT2")) == 12 and one(spark, N.spelling_variants(F.col("t")), "Echo") == ["Echo"]


def test_relatives(spark):
    younger, plain, grand = (one(spark, N.relative(F.col("t")), t) for t in ("Ann Lee (Younger Sister)", "Bob (Twin Brother)", "Old Joe (Grandfather)"))
    assert (younger.name, younger.base, younger.age) == ("Ann Lee", "sister", "younger") and (plain.base, plain.age, grand.base) == ("brother", None, "grandfather")
    match = lambda t, base, age: one(spark, N.relative_match(N.relative(F.col("t")), base, age), t)
    assert [match("A (Younger Sister)", "sister", a) for a in ("younger", "older", None)] == ["exact", "contrast", "exact"]
    assert match("B (Twin Brother)", "brother", "younger") == "loose" and match("C (Grandfather)", "father", None) is None
