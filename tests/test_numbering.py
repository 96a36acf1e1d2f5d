import random

from pyspark.sql import functions as F

from loomspark.operators import numbering


def test_running_total(spark, monkeypatch):
    monkeypatch.setattr(numbering, "FAN_BITS", 2)
    rnd = random.Random(1)
    rows = [(rnd.choice("aab"), rnd.randrange(64), i, rnd.randrange(9)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, b long, i long, v long").repartition(5)
    got = {r.i: r.t for r in numbering.running_total(df, ["k"], "b", 6, ["i"], F.col("v"), "t").collect()}
    want, held = {}, {"a": 0, "b": 0}
    for k, _, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        want[i] = held[k]
        held[k] += v
    assert got == want


def test_gapless_ids(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([None, "a", "b", "é", "Z"]), i) for i in range(200)]
    df = spark.createDataFrame(rows, "s string, i long").repartition(7)
    got = sorted((r.n, r.s, r.i) for r in numbering.gapless_ids(df, [F.col("s").asc_nulls_last(), "i"], "n", 1).collect())
    want = sorted(rows, key=lambda r: (r[0] is None, (r[0] or "").encode(), r[1]))
    assert got == [(n + 1, *r) for n, r in enumerate(want)]
    assert numbering.gapless_ids(df.where("false"), ["s"]).count() == 0
