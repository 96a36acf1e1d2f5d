"""Queries that take every row, where their namesakes with SQL take a part, against brute force."""

import random
import re

import numpy as np

from loomspark.operators import vector
from loomspark.plans import registry


def saved(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")


def test_cosine_topk_all(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK", 16)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 5)).astype(np.float32)
    x[40:55], x[60] = x[3], 0
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    saved(spark, tmp_path, "embeddings", [*rows, (200, None), (201, [float("nan")] * 5), (None, [1.0] * 5)], "vec_id long, embedding array<float>")
    u = x.astype(np.float64)
    u /= np.maximum(np.sqrt((u * u).sum(axis=1, keepdims=True)), 1e-300)
    scores = np.round(u @ u.T, 6)
    want = [(q, rank + 1, int(v)) for q in range(90) for rank, v in enumerate(np.lexsort((np.arange(90), -scores[q]))[:5])]
    got = registry.queries()["cosine_topk_all"](spark, str(tmp_path)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == want
    assert all(abs(r.score - scores[r.query_id, r.vec_id]) < 2e-6 for r in got)


def test_keyword_snippets_all(spark, tmp_path):
    rnd = random.Random(4)
    words = ["nation", "nationa", "ational", "banana", "ananas", "anananana", "internationally", "zzzzzz", "Nation", "short"]
    texts = ["".join(rnd.choice(words) + rnd.choice([" ", "", "-", "7", "É"]) for _ in range(rnd.randint(0, 30))) for _ in range(60)]
    items = [" ".join(rnd.choice(words) for _ in range(4)) for _ in range(25)]
    saved(spark, tmp_path, "documents", [*enumerate(texts), (99, None)], "doc_id long, text string")
    saved(spark, tmp_path, "benchmark", list(enumerate(items)), "item_id long, text string")
    want = []
    for q, item in enumerate(items):
        asked = set(re.findall("[a-z]{6,}", item.lower()))
        hits = sorted((-n, len(t), d) for d, t in enumerate(texts) if (n := sum(t.count(w) for w in asked)))
        want += [(q, rank + 1, d, -n) for rank, (n, _, d) in enumerate(hits[:3])]
    got = registry.queries()["keyword_snippets_all"](spark, str(tmp_path)).collect()
    assert {q for q, *_ in want} > set(range(10)) and sorted((r.query_id, r.rank, r.doc_id, r.hits) for r in got) == sorted(want)


def test_linking_all(spark, tmp_path):
    parts = [(1, "red bolt", "PLAIN STEEL"), (2, "red", "RED BOLT"), (3, "blue nut", "LARGE RED"), (4, "red bolt", "PLAIN TIN")]
    lines = [(7, 1, 1), (7, 2, 3), (7, 2, 2), (7, 3, 4), (8, 2, 3), (9, 1, 2), (9, 1, 2)]
    saved(spark, tmp_path, "part", parts, "p_partkey long, p_name string, p_type string")
    saved(spark, tmp_path, "lineitem", lines, "l_orderkey long, l_linenumber int, l_partkey long")
    run = lambda name: sorted(map(tuple, registry.queries()[name](spark, str(tmp_path)).collect()))
    whole = {"7-1-1": 1, "7-2-1": 2, "7-2-2": 3, "7-3-1": 4, "8-2-1": 3, "9-1-1": 2, "9-1-2": 2}
    said = {q: f"ship the {n} please {t.lower()}" for q, p in whole.items() for i, n, t in parts if i == p}
    names = {"red bolt": 1, "red": 2, "blue nut": 3}
    want = [(q, e, n, len(re.findall(rf"\b{n}\b", t))) for q, t in said.items() for n, e in names.items() if re.search(rf"\b{n}\b", t)]
    assert run("dictionary_mentions_all") == sorted(want)
    best = {q: min((-len(n), n, e) for r, e, n, _ in want if r == q) for q in whole}
    assert run("longest_match_all") == sorted((q, e, n) for q, (_, n, e) in best.items())
    red = {1000002: "red", 2: "red"}
    free = [(q, names["red bolt"], n) for q, t in said.items() if (n := t.count("red bolt"))] + [(q, 3, 1) for q, t in said.items() if "blue nut" in t]
    free += [(q, e, n) for q, t in said.items() for e in red if (n := len(re.findall(r"\bred\b(?! bolt)", t)))]
    assert run("shadow_elimination_all") == sorted(free)


def test_cosine_top_by_parts_and_groups(spark, monkeypatch):
    """Parts of queries and groups of blocks lose nothing; what is null or not finite takes no part."""
    monkeypatch.setattr(vector, "BLOCK", 40)
    monkeypatch.setattr(vector, "GROUPS", 3)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, 5)).round(1)
    x[20:40] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (905, [None, 1.0]), (910, [float("nan")] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = vector.cosine_top(df.where("vec_id % 5 = 0").withColumnsRenamed({"vec_id": "query_id", "v": "q"}), df, 7).collect()
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    want = []
    for q in range(0, 500, 5):
        s = np.round(unit @ unit[q], 6) + 0.0
        want += [(q, n + 1, int(i), float(s[i])) for n, i in enumerate(np.lexsort((np.arange(500), -s))[:7])]
    assert sorted(tuple(r) for r in got) == want


def test_gold_by_runs_of_few_probes(spark, monkeypatch):
    """No run of words but a probe's leaves the task that reads the text; runs over two texts are none; many probes alike."""
    from loomspark.operators import evaluation
    from loomspark.sources import tables

    word = lambda i, n: " ".join(f"w{k}" for k in range(i, i + n))
    items = spark.createDataFrame([(1, word(0, 9)), (2, word(20, 8)), (3, word(40, 7)), (4, "W0, w1; " + word(2, 6)), (5, None)], "item_id long, text string")
    texts = [(10, "x " + word(0, 8) + " y"), (11, word(16, 8)), (12, word(24, 30)), (13, word(18, 12)), (14, None), (15, ""), (16, word(0, 8) + " " + word(0, 8)), (17, word(0, 4)), (18, word(4, 6))]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    want = [(1, 10), (1, 16), (2, 13), (4, 10), (4, 16)]
    found = evaluation.probe_gold(items, "item_id", docs, "doc_id")
    assert sorted(map(tuple, found.collect())) == want and "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 1)
    assert sorted(map(tuple, evaluation.probe_gold(items, "item_id", docs, "doc_id").collect())) == want
