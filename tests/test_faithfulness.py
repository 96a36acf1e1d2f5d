import random

from loomspark.operators import evidence as E
from loomspark.operators import faithfulness as Fa
from loomspark.plans import evidence as P

EVIDENCE = "Tower of Gray is a close-range Stand. Destructive Power: A, Speed: C, Range: 5 m."
CASES = [  # (answer, said, supported)
    ("可以将破坏力等级定为 5 级。", 1, 1), ("破坏力是 A 级。", 1, 1), ("破坏力是 C 级。", 1, 0), ("破坏力是 3 级。", 1, 0), ("射程是 5 米。", 1, 1), ("射程是 300 米。", 1, 0), ("速度是 C。", 1, 1), ("速度是 A。", 1, 0),
    ("破坏力不是 A 级。", 1, 0), ("破坏力不是 B 级", 1, 1), ("Its power is A and its speed is not C", 2, 1), ("The range is 5 m; speed level is 3.", 2, 2), ("Power is a thing, precision unknown", 0, 0), ("破坏力：1. 缩小敌人", 0, 0),
    ("There are 5 forms and 7 moves", 2, 1), ("stamina is 5", 1, 1), ("stamina is unknown", 1, 0), (None, 0, 0), ("", 0, 0), ("POWER IS B, Power = A", 2, 1),
]


def test_numeric_cases(spark):
    answers = spark.createDataFrame([(i, a) for i, (a, _, _) in enumerate(CASES)] + [(None, "power is A"), (99, "power is A")], "id long, answer string")
    evidence = spark.createDataFrame([(i, EVIDENCE) for i in range(len(CASES))] + [(99, None), (None, EVIDENCE)], "id long, text string")
    got = {r.id: (r.n_said, r.n_supported, r.share) for r in Fa.numeric_shares(answers, evidence, "id", "answer", "text").collect()}
    for i, (answer, said, ok) in enumerate(CASES):
        assert got[i] == (said, ok, round(ok / said, 4) if said else None), answer
    assert got[99] == (1, 0, 0.0)


def test_windows(spark):
    texts = [(1, "Power: A, Speed: C"), (2, "power one two three four B"), (3, "power one two three four five B 7"), (4, "destructive power e; rng 5.5 m (20 ft) x y z w v 9"), (5, "dev 3")]
    got = {(r.id, r.dim, r.kind, r.value) for r in Fa.written_values(spark.createDataFrame(texts, "id long, t string"), "id", "t").collect()}
    assert got == {(1, "power", "grade", "A"), (1, "speed", "grade", "C"), (2, "power", "grade", "B"), (3, None, "grade", "B"), (3, None, "number", "7"), (4, "power", "grade", "E"), (4, "range", "number", "5.5"), (4, "range", "number", "20"), (4, None, "number", "9"), (5, "potential", "number", "3")}


def test_others_evidence(spark):
    for owners in (["a"] * 5 + ["b"] * 4 + ["c", None], ["a"] * 9 + ["b", "c"], ["a"] * 3, []):
        pieces = spark.createDataFrame([(i % 4, o, i) for i, o in enumerate(owners)], "item long, owner string, k long")
        rows = E.others_evidence(pieces, "item", "owner", ["k"]).collect()
        of = {r.n: r.owner for r in rows}
        assert sorted(of) == list(range(len(owners)))
        if len(set(owners)) > 1:
            assert all(of[r.stands_in] != r.owner for r in rows)
            assert len({r.stands_in for r in rows}) == len(rows) or owners.count("a") * 2 > len(owners)


def test_anchors(spark):
    text = "the quick brown fox jumps over the lazy dog and back again over the quick wall"
    for window in E.WINDOWS:
        every = set(E.anchors_of(text, window).tolist())
        assert all(E.anchors_of(text[i : i + window], window)[0] in every for i in range(len(text) - window + 1)) and len(every) < len(text) - E.GRAM + 1
    probes = spark.createDataFrame([(1, text[3:60]), (2, text[10:30]), (3, "lazy dog"), (4, text[5:40] + "!"), (5, None)], "p long, probe string")
    texts = spark.createDataFrame([(1, text), (2, None), (3, text.upper()), (4, "x" + text[:45]), (5, "")], "t long, text string")
    assert sorted(map(tuple, E.containing(probes, "p", texts, "t").collect())) == [(1, 1), (2, 1), (2, 4)]


def test_evidence_kinds(spark):
    chunks = spark.createDataFrame([(5, "a", "S", "one"), (4, "a", "S", "two"), (3, "a", None, "a passage that  is long enough to be found again"), (2, "b", "T", "a passage that is long enough to be found again"), (1, None, "S", "x")], "chunk_id long, owner string, section string, content string")
    text = " a passage that is long\nenough "
    records = [(1, "a", "S", text), (2, "a", "T", text), (3, "a", None, "too short a text"), (4, None, "S", text), (5, "c", "S", text), (6, "a", "T", None)]
    got = {r.record_id: (r.chunk_id, r.found_by) for r in E.evidence_chunks(spark.createDataFrame(records, "record_id long, owner string, section string, text string"), chunks).collect()}
    assert got == {1: (4, "section"), 2: (3, "text"), 3: (None, None), 4: (None, None), 5: (None, None), 6: (None, None)}


def test_texts_are_read_once_for_anchors(spark):
    """Anchors of a batch are those of each text alone, and neither chunks nor probes are cut anew for each window."""
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abcé") for _ in range(n)) for n in (0, 7, 8, 15, 16, 17, 31, 32, 33, 200, 0, 40)]
    for window in E.WINDOWS:
        text, _, anchor = E._anchors(texts, (window,))
        assert [sorted(anchor[text == i].tolist()) for i in range(len(texts))] == [sorted(E.anchors_of(t, window).tolist()) for t in texts]
        for i, t in enumerate(texts):
            assert {int(E.anchors_of(t[k : k + window], window)[0]) for k in range(len(t) - window + 1)} == set(anchor[text == i].tolist())
    frame = spark.createDataFrame(list(enumerate([*texts, None])), "t long, text string")
    probes = spark.createDataFrame([(1, texts[9][3:20]), (2, texts[9][5:60]), (3, texts[11]), (4, "abc")], "p long, probe string")
    found = E.containing(probes, "p", frame, "t")
    assert sorted(map(tuple, found.collect())) == [(1, 9), (2, 9), (3, 11)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") <= 3  # texts once; probes, and once more for the filter on what is found
    plan = P._chunks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
