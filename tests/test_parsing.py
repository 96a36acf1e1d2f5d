"""Parsers, audits and questions on cases that the tables do not hold."""

import pytest
from pyspark.sql import functions as F

from loomspark.functions import parsing as P
from loomspark.functions.encoding import encode_literal
from loomspark.functions.records import split_names
from loomspark.operators import asking, audit


def test_literals_are_cut_once_at_the_mark(spark):
    raws = ["B※20 m", "B ※ a※b", "?※Power: A", "※Complete", "B※", "F※x", "None※x", "A", "∞"]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    got = [(r.x.value, r.x.category, r.x.note) for r in rows.select("i", encode_literal(F.col("raw")).alias("x")).orderBy("i").collect()]
    none = "CONDITIONAL_NO_BASE"
    assert got == [(4, "CONDITIONAL", "20 m"), (4, "CONDITIONAL", "a※b"), (None, none, "Power: A"), (None, none, "Complete"), (None, "UNPARSED", "B※"), (None, "UNPARSED", "F※x"), (None, none, "x"), (5, "RANKED", None), (None, "INFINITE", None)]


def test_templates_and_fields():
    assert P._templates("{{A|{{A|x}}}} {{a}} {{A|open", "a") == ["{{A|{{A|x}}}}", "{{a}}"]
    assert P._templates(None, "a") == P._templates("", "a") == []
    assert P._fields("{{A|x|k = {{b|c}}|k=2|[[d|e]]}}") == {"1": "x", "k": "{{b|c}}", "4": "[[d|e]]"}


def test_nulls_and_names(spark):
    row = spark.createDataFrame([(None, "JohnMcCoyDragona")], "t string, n string").select(
        P.origin(F.col("t")).alias("o"), P.place_paths(F.col("t")).alias("p"), P.html_rows(F.col("t")).alias("h"), split_names(F.col("n")).alias("n"), asking.said_names(F.col("t")).alias("s")
    ).first()
    assert (row.o.kind, row.o.note, row.p, row.h, row.s) == ("unknown", None, [], [], [])
    assert row.n == ["John", "McCoy", "Dragona"]


def test_status_and_audit(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    assert [audit.with_status(rows, s, "v").count() for s in ("all", "pending", "resolved")] == [2, 1, 1]
    with pytest.raises(ValueError):
        audit.with_status(rows, "other", "v")
    found = audit.apply_resolutions(spark.createDataFrame([(1, "a", "human"), (2, "b", "rule"), (3, None, None), (4, "c", "rule")], "id int, resolved_value string, resolved_by string"), spark.createDataFrame([(1, "z"), (2, "z"), (4, "c")], "id int, new_value string"), "id")
    assert {(r.id, r.value, r.action) for r in found.collect()} == {(1, "a", "kept"), (2, "z", "updated"), (3, None, "open"), (4, "c", "updated")}
    assert [r.id for r in audit.audit_log(found, "id").collect()] == [2]


def test_made_up_names(spark):
    names = spark.createDataFrame([("cream", 1), ("sea", 2)], "name string, entity_id int")
    asked = spark.createDataFrame([(1, "cream"), (2, "cream starter"), (3, "creamy"), (4, "other"), (5, None)], "query_id int, term string")
    assert {r.query_id: r.standing for r in asking.known_names(asked, names).collect()} == {1: "known", 2: "fabricated", 3: "unknown", 4: "unknown", 5: "none"}


def test_names_are_no_cues(spark):
    names = spark.createDataFrame([("how many chapters", 1), ("list of speed moves", 2)], "name string, entity_id int")
    rows = [(1, 'What is the power of "How Many Chapters"?'), (2, 'Who owns "List of speed moves"?'), (3, None), (4, ""), (5, 'Where is "Harbour"'), (6, '"' + "a" * 200_000 + '" power')]
    got = {r.query_id: (r.intent, r.dim, r.standing, r.route) for r in asking.understood(spark.createDataFrame(rows, "query_id int, question string"), names).collect()}
    assert got == {
        1: ("fact", "power", "known", "structured"), 2: ("owner", None, "known", "structured"), 3: ("unknown", None, "none", "abstain"), 4: ("unknown", None, "none", "abstain"),
        5: ("unknown", None, "unknown", "abstain"), 6: ("unknown", "power", "unknown", "abstain"),
    }


ORIGINS = [
    ("Stand Arrow → Enya (Signal)", "arrow", "Enya"), ("arrow->Yoshihiro, later", "arrow", "Yoshihiro"), ("An ARROW", "arrow", None), ("narrow escape", "unknown", None), ("Arrows → X", "unknown", None), ("Natural-born", "natural", None),
    ("natural  Stand user", "natural", None), ("Devil's Palm Exposure by arrow → X", "exposure", None), ("Wall Eyes\nexposure", "exposure", None), ("Saints Corpse", "saint_corpse", None), ("Green Baby", "merge", None), ("feng-shui assassination", "technique", None),
    ("Son  of the owner", "bloodline", None), ("Descendants", "bloodline", None), ("", "unknown", None), ("x → arrow", "arrow", None),
]


def test_origins(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(ORIGINS)], "i int, t string").select("i", P.origin(F.col("t")).alias("o"))
    assert [(r.o.kind, r.o.note) for r in rows.orderBy("i").collect()] == [(k, n) for _, k, n in ORIGINS]


def test_rows_of_nested_tables(spark):
    html = "<table><tr><td>a &amp; b<td><table><tr><td>inner</table></td></tr><tr><td>c<td>d</table>"
    rows = spark.createDataFrame([(html,)], "h string").select(P.html_rows(F.col("h")).alias("r"), P.html_rows(F.col("h"), 3).alias("n"))
    assert rows.first().r == [["a & b", ""], ["c", "d"]] and rows.first().n == []
