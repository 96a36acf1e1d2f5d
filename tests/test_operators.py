"""Semantics that the tables do not show: literals, Han text, packing, merging, sinks, streams."""

import json

import pytest
from pyspark.sql import functions as F

from loomspark.functions import encoding, text
from loomspark.operators import chunking, linking, merging, relational, routing
from loomspark.sources import tables


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "value", "category", "note"),
    [
        ("A", 5, "RANKED", None), ("E", 1, "RANKED", None), ("None", 0, "NONE", None), ("∅", None, "EMPTY_SLOT", None), ("N/A", None, "EMPTY_SLOT", None), ("?", None, "UNKNOWN", None),
        ("∞", None, "INFINITE", None), ("Infi", None, "INFINITE", None), ("situational", None, "CONDITIONAL_NO_BASE", "varies by context"), ("", None, "NOT_APPLICABLE", None),
        ("B※20-30 meters", 4, "CONDITIONAL", "20-30 meters"), ("C※Range: 2 m (6.6 ft)", 3, "CONDITIONAL", "Range: 2 m (6.6 ft)"), ("?※Power: Likely A (p.245)", None, "CONDITIONAL_NO_BASE", "Power: Likely A (p.245)"),
        ("※Complete", None, "CONDITIONAL_NO_BASE", "Complete"), ("A A A", None, "UNPARSED", "A A A"), ("A ", 5, "RANKED", None), ('B"', 4, "RANKED", None), (None, None, "NOT_APPLICABLE", None),
    ],
)
def test_encode_literal(spark, raw, value, category, note):
    x = one(spark, encoding.encode_literal(F.col("raw")), raw=raw)
    assert (x.value, x.category, x.note, x.raw) == (value, category, note, raw or "")


def test_tokens_of_mixed_text(spark):
    assert one(spark, text.tokens(F.col("t")), t="The Red 红 x2 and 色猫") == ["red", "x2", "红", "色", "猫", "红色", "色猫"]
    assert one(spark, text.tokens(F.col("t")), t=None) == []


def test_let_and_grams(spark):
    assert one(spark, text.char_grams(F.col("t")), t="Ab") == ["  a", " ab", "ab ", "b  "]
    assert one(spark, linking.word_grams(F.col("t"), 2), t="One two, three") == ["one two", "two three"]
    assert one(spark, linking.word_grams(F.col("t"), 2), t="one") == []


def test_html_to_text(spark):
    html = "<html><head><title>x</title></head><body><nav><a>m</a></nav><h1>T &amp; U</h1><p>a<br>b</p><script>z</script><footer>f</footer></body></html>"
    assert one(spark, text.html_to_text(F.col("t")), t=html) == "## T & U\na\nb"


def packs_by_loop(rows, target, overlap):
    out, buf = [], []
    for pos, content in rows:
        n = len(content)
        if n >= target:
            if buf:
                out.append(buf)
            out.append([pos])
            buf = []
            continue
        size = sum(len(dict(rows)[p]) for p in buf)
        if buf and size + n > target:
            out.append(buf)
            buf = buf[-overlap:] if overlap else []
        buf = buf + [pos]
    return out + ([buf] if buf else [])


@pytest.mark.parametrize("overlap", [0, 1, 2])
def test_pack_like_a_loop(spark, overlap):
    rows = [(i, "x" * n) for i, n in enumerate([5, 7, 3, 30, 2, 2, 9, 9, 1, 20, 19, 1, 8])]
    df = spark.createDataFrame([(1, p, c) for p, c in rows] + [(2, 0, "only")], "doc_id long, pos int, content string")
    got = chunking.pack(df, "doc_id", 20, overlap).orderBy("doc_id", "pack").collect()
    assert [r.base for r in got if r.doc_id == 1] == packs_by_loop(rows, 20, overlap)
    assert [r.content for r in got if r.doc_id == 2] == ["only"]


def test_equivalence_keeps_unknown_from_empty(spark):
    df = spark.createDataFrame([("∅", "None"), ("?", "∅"), ("A", "A"), ("A", "B"), ("※x", "∅"), ("A", "∅"), ("?", "∞")], "x string, y string")
    a, b = encoding.encode_literal(F.col("x")), encoding.encode_literal(F.col("y"))
    got = [tuple(r) for r in df.select(merging.equivalent(a, b), merging.conflict_type(a, b)).collect()]
    assert [g[0] for g in got] == [True, False, True, False, False, True, True]
    assert got[1][1] == "MISSING_IN_ONE" and got[3][1] == "VALUE_MISMATCH"


def test_upsert_and_insert(spark):
    old = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (None, "m")], "k int, v string")
    assert {tuple(r) for r in relational.upsert(old, new, ["k"]).collect()} == {(1, "b"), (2, "c"), (None, "m")}
    assert {tuple(r) for r in relational.insert_if_absent(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (None, "n")}


def test_pronouns(spark):
    assert one(spark, routing.resolve_pronoun(F.col("q"), F.col("c")), q="What is its range?", c="Lamp") == "What is Lamp range?"
    assert one(spark, routing.resolve_pronoun(F.col("q"), F.col("c")), q="What is its range?", c=None) == "What is its range?"


def test_json_and_csv_scans(spark, tmp_path):
    schema = "id int, name string"
    from pyspark.sql.types import StructType

    empty = tables.json_scan(spark, str(tmp_path / "no.json"), StructType.fromDDL(schema))
    assert empty.count() == 0
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "name": "x"}]))
    assert tables.json_scan(spark, str(tmp_path / "a.json"), StructType.fromDDL(schema)).first().name == "x"
    (tmp_path / "a.csv").write_bytes("key,wrong\n1,café\n".encode("latin-1"))
    assert tables.csv_scan(spark, str(tmp_path / "a.csv"), ["id", "name"]).first().name == "café"


def test_session_stream(spark, tmp_path):
    from loomspark.streaming.sessions import last_entity, session_counts

    rows = [(1, 0, "a"), (1, 60, None), (1, 4000, None), (2, 10, "b"), (9, 90000, None)]
    spark.createDataFrame(rows, "user_id long, s long, entity string").select("user_id", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"), "entity").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, ts timestamp, entity string").parquet(str(tmp_path / "in"))
    for name, frame in (("counts", session_counts(stream)), ("entities", last_entity(stream))):
        q = frame.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).outputMode("append").start()
        q.processAllAvailable()
        q.awaitTermination(60)
        q.stop()
    assert sorted((r.user_id, r.n) for r in spark.table("counts").collect()) == [(1, 1), (1, 2), (2, 1)]
    assert sorted((r.user_id, r.context) for r in spark.table("entities").collect() if r.context) == [(1, "a"), (1, "a"), (2, "b")]


def test_windows_and_their_chunks(spark):
    """Windows and chunks meet by places; held against the joined texts."""
    from loomspark.operators import chunking as C

    texts = {1: ["one two", " ", "three  four five", "six"], 2: ["x" * 30], 3: ["", "  "], 4: ["a", "b", "c", "d" * 9, "e"]}
    chunks = spark.createDataFrame([(d, i, c) for d, held in texts.items() for i, c in enumerate(held)], "doc_id long, pos int, content string")
    for size, overlap in ((6, 2), (10, 3), (2, 0), (50, 5)):
        want = []
        for d, held in texts.items():
            parts, at = [], 0
            for i, c in enumerate(held):
                if c := " ".join(c.split()):
                    parts.append((i, max(at - 1, 0), at + len(c), c))
                    at += len(c) + 1
            text, step = " ".join(p[3] for p in parts), size - overlap
            for w in range(1 if len(text) <= size else -(-len(text) // step)):
                content = text[w * step : w * step + size]
                want += [(d, w, i) for i, low, high, _ in parts if low < w * step + len(content) and high > w * step]
        plan = C.window_sources(chunks, "doc_id", size, overlap)
        assert sorted(map(tuple, plan.collect())) == sorted(want)
        assert plan.schema["window"].dataType.simpleString() == "int" and "collect_list" not in plan._jdf.queryExecution().toString()
