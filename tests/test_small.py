"""Functions that no query's SQL reaches."""

from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import evaluation as E
from loomspark.sources import tables


def test_interval_coverage(spark):
    gold = spark.createDataFrame([("a", 0, 10), ("a", 20, 30), ("b", 0, 4), ("c", 5, 5), ("a", 0, 10)], "doc string, low int, high int")
    found = spark.createDataFrame([("a", 1, 4), ("a", 3, 6), ("a", 2, 3), ("a", 9, 40), ("b", 9, 12), ("d", 0, 9)], "doc string, low int, high int")
    got = {(r.doc, r.low): r.share for r in E.interval_coverage(gold, found, "doc").collect()}
    assert got == {("a", 0): 0.6, ("a", 20): 1.0, ("b", 0): 0.0, ("c", 5): 0.0}


def test_trace_coverage(spark):
    rows = [(1, "The red fox jumps high. Nothing of this stands there!", "A red fox jumps high up"), (2, "red high fox", "high red fox"), (3, "", "x"), (4, "Of the.", "y"), (5, "red fox", None)]
    got = {r.query_id: (r.n_sentences, r.supported, r.share) for r in E.trace_coverage(spark.createDataFrame(rows, "query_id int, answer string, evidence string")).collect()}
    assert got == {1: (2, 1, 0.5), 2: (1, 0, 0.0), 4: (1, 1, 1.0), 5: (1, 0, 0.0)}


def test_mean_metrics(spark):
    rows = spark.createDataFrame([(1, 1.0, None), (2, 0.0, 0.5), (3, 0.5, 0.25)], "query_id int, a double, b double")
    assert E.mean_metrics(rows).collect() == [(3, 0.5, 0.375)]


def test_texts(spark):
    row = spark.createDataFrame([("a [12] b[c]  [long] ", "<head>no</head><p>one &lt; two<br>three<h2>H</h2><script>x</script><!-- c -->")], "t string, h string").select(T.clean_text(F.col("t")).alias("t"), T.html_to_text(F.col("h")).alias("h")).first()
    assert row.t == "a b [long]" and row.h == "one < two\nthree\n## H"


def test_union_scan(spark):
    a, b = spark.createDataFrame([(1, "x")], "id int, t string"), spark.createDataFrame([(2, 0.5), (2, 0.5)], "id int, s double")
    assert sorted(map(tuple, tables.union_scan(a, b).collect()), key=str) == sorted([(1, "x", None), (2, None, 0.5), (2, None, 0.5)], key=str)
