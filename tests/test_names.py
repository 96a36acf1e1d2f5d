import random
import re

from loomspark.operators import linking as L
from loomspark.operators import names as N


def test_arbitration(spark):
    rows = [
        (1, "official", 0, "白金之星"), (1, "fetched", 0, "白金"), (1, "added", 0, "白金之星"),  # official, one variant
        (2, "official", 0, "黄金体験"), (2, "fetched", 1, "黄金乙"), (2, "fetched", 0, "黄金体验"),  # other forms give way
        (3, "official", 0, "牙"), (3, "added", 0, "爪"), (3, "added", 1, "獠牙"),  # not usable: the first usable addition
        (4, "official", 0, "面"),  # none usable
        (5, "forced", 0, "杀手皇后"), (5, "official", 0, "皇后杀手"), (5, "fetched", 0, "素质"),  # what is replaced stays a variant
        (6, "fetched", 0, "穿心攻击"), (6, "added", 0, "皇后杀手"), (6, "added", 1, "素质"), (6, "added", 2, "杀手皇后"),  # shared, and another's name
        (7, "fetched", 0, "白金之星"), (None, "fetched", 0, "无主"), (8, "fetched", 0, None), (1, "official", 0, "白金之星"),
    ]
    names, variants = N.arbitrated(spark.createDataFrame(rows, "entity_id long, source string, place int, name string"))
    got = {r.entity_id: (r.name, r.level, r.source, r.rejected) for r in names.collect()}
    assert got == {
        1: ("白金之星", "A", "official", None), 2: ("黄金体验", "C", "fetched", None), 3: ("獠牙", "C", "added", "牙"), 5: ("杀手皇后", "B", "forced", None),
        6: ("穿心攻击", "C", "fetched", None), 7: ("白金之星", "C", "fetched", None),
    }
    assert sorted((r.entity_id, r.name) for r in variants.collect()) == sorted([(1, "白金"), (2, "黄金乙"), (3, "爪"), (5, "皇后杀手")])
    assert [tuple(r) for r in N.shared_names(names).collect()] == [("白金之星", 2, 1)]
    assert {r.alias: r.entity_id for r in N.name_table(names, variants).collect()}["白金之星"] == 1


def looped(units, names, least, most, one_shorter):
    held = {}
    for eid, u in names:
        for i in range(len(u)):
            for m in range(least, most + 1):
                if i + m <= len(u) and (not one_shorter or len(u) - m == 1):
                    held.setdefault(tuple(u[i : i + m]), set()).add(eid)
    spans = sorted(((i, i + m) for m in range(least, most + 1) for i in range(len(units) - m + 1) if tuple(units[i : i + m]) in held), key=lambda s: (s[0] - s[1], s[0]))
    taken, out = [], set()
    for low, high in spans:
        if all(high <= a or low >= b for a, b in taken):
            taken.append((low, high))
            out |= {(low, high, " ".join(units[low:high]), e) for e in held[tuple(units[low:high])]}
    return out


def test_fuzzy_spans(spark):
    rnd = random.Random(4)
    names = [(i, [rnd.choice("abcd") for _ in range(rnd.randint(1, 5))]) for i in range(9)] + [(9, [])]
    texts = [(i, [rnd.choice("abcdx") for _ in range(rnd.randint(0, 14))]) for i in range(40)] + [(40, None)]
    left, right = spark.createDataFrame(texts, "text_id long, units array<string>"), spark.createDataFrame(names, "entity_id long, units array<string>")
    for one_shorter in (False, True):
        got = {}
        for r in L.fuzzy_spans(left, "text_id", right, 2, 4, one_shorter).collect():
            got.setdefault(r.text_id, set()).add((r.low, r.high, r.fragment, r.entity_id))
        assert got == {i: x for i, u in texts if u is not None and (x := looped(u, names, 2, 4, one_shorter))}


def test_fuzzy_queries(spark, tmp_path):
    from loomspark.plans import registry

    parts = [(i, f"{a} {b}", t, "x") for i, (a, b, t) in enumerate([("red", "bolt", "TIN CAN"), ("blue", "nut", "TIN CAN"), ("red", "nut", "BIG TIN CAN")], 1)]
    orders = [(i, i % 3) for i in range(7)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    units = [(i, re.findall("[a-z0-9]+", f"{n} {t}".lower())) for i, n, t, _ in parts]
    known = [(i, u if i % 2 else u[:2]) for i, u in units]
    for query, one in (("fuzzy_name_spans", False), ("fuzzy_one_shorter", True)):
        want = set()
        for o, c in orders:
            w = dict(units)[c % 200 + 1]
            want |= {(o, *x) for x in looped(["send", *w[:-1], "or", "the", *w[1:3]], known, 2, 6, one)}
        rows = registry.queries()[query](spark, str(tmp_path)).collect()
        spans, bearers = [r for r in rows if r.text_id is not None], [r for r in rows if r.text_id is None]
        meant = {f: {r.entity_id for r in bearers if r.fragment == f} for f in {r.fragment for r in bearers}}
        assert {(r.text_id, r.low, r.high, r.fragment, e) for r in spans for e in meant[r.fragment]} == want
        assert len(spans) == len({x[:3] for x in want}) and len(bearers) == len({x[3:] for x in want})  # no product of the two
        assert all(r.n_names == len(meant[r.fragment]) for r in rows) and set(meant) == {r.fragment for r in spans}


def test_entities_are_never_broadcast(spark, tmp_path, monkeypatch):
    """Entities meet no table of entities: a broadcast by bytes of files, of which made names are many times as large, has
    filled the driver. What is told of a name is counted before it is broadcast."""
    from loomspark.plans import registry
    from loomspark.sources import tables

    spark.range(400).selectExpr("id as p_partkey", "'x' as p_name").write.parquet(f"{tmp_path}/part.parquet")
    run = lambda: registry.queries()["arbitrated_variants"](spark, str(tmp_path))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    first = run()
    assert "BroadcastHashJoin [entity_id" not in plan(first)
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 1)
    second = run()
    assert "Broadcast" not in plan(second) and sorted(first.collect()) == sorted(second.collect()) != []
