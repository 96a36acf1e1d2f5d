"""Work is dealt out by rows, not by the bytes of files or shuffles."""

import random

from pyspark.sql import functions as F

from loomspark.functions import markup
from loomspark.operators import asking as Q
from loomspark.operators import faithfulness as Fa
from loomspark.operators import merging as M
from loomspark.plans import registry
from loomspark.sources import tables

DIR = "/root/testdata/sf0.001"


def test_judges_are_dealt(spark):
    for name in ("judge_answers", "longest_match"):
        assert "REPARTITION_BY_NUM" in registry.queries()[name](spark, DIR)._jdf.queryExecution().toString()


def test_sentences_are_read_once(spark):
    """The words of a sentence are looked up before it meets its order lines."""
    for name in ("dictionary_mentions", "longest_match", "shadow_elimination"):
        plan = registry.queries()[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("l_partkey") < (plan.index("Generate") if "Generate" in plan else len(plan))


def test_cells_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS_A_TASK", 10)
    cells = spark.range(300).select(F.col("id").alias("entity_id"), F.lit(0).alias("dim"), F.lit("A").alias("raw"))
    monkeypatch.setattr(M, "CELLS_A_TASK", 10)
    merged = M.three_source_merge(cells, {"m": cells.withColumn("raw", F.lit("B"))})
    assert merged.rdd.getNumPartitions() == 30 and merged.count() == 300
    monkeypatch.setattr(Q, "CELLS_A_TASK", 10)
    said = spark.createDataFrame([(1, "power", "A", False), (1, "speed", "B", True), (2, "power", "C", False)], "id long, dim string, grade string, negated boolean")
    truth = spark.range(300).select("id", F.lit("power").alias("dim"), F.lit("A").alias("label"))
    told = Q.checked(said, "id", truth)
    assert told.rdd.getNumPartitions() == 30 and sorted(map(tuple, told.collect())) == [(1, 2, 1, 0, 1.0), (2, 1, 0, 1, 0.0)]
    monkeypatch.setattr(Fa, "TEXTS_A_TASK", 10)
    texts = spark.range(300).select("id", F.lit("Power is A").alias("t"))
    assert Fa.numeric_shares(texts, texts.withColumn("t", F.lit("power: a")).withColumnRenamed("t", "e"), "id", "t", "e").rdd.getNumPartitions() == 30


def test_plain_pages_as_the_parser_reads_them():
    def shown(node):
        return [x if isinstance(x, str) else (x.tag, x.attrs, shown(x)) for x in node.children]

    pieces = ["<table>", "</table>", "<tr>", "<td>", '<td colspan="2">', '<TH Rowspan="3" class="a b">', "</td>", "<p>", "</p>", "<br>", "<h3>", "</h3>", "text ", "\n", "<div>", "</div>", '<a href="x" href="y">', "</a >"]
    rng = random.Random(5)
    for _ in range(400):
        html = "".join(rng.choices(pieces, k=rng.randrange(12)))
        parser = markup._Builder()
        parser.feed(html)
        parser.close()
        assert markup._simple(html) is not None and shown(markup.tree(html)) == shown(parser.root), html
    for odd in ("a &amp; b", "1 < 2", "<br/>", "<!-- x -->", "<script>a</script>", "<a href=x>", "<p", "</p x=\"1\">"):
        assert markup._simple(odd) is None
