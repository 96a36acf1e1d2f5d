"""Shuffle files of an intermediate table go with its write."""

from pyspark.sql import functions as F

from loomspark.llm import common as C
from loomspark.llm import toxicity
from loomspark.sources import storage

from .test_text_ops import toxic_docs


def shuffles(spark):
    return set(spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().keys().mkString(",").split(",")) - {""}


def test_cleanup(spark):
    seen = []
    for module in (C, storage):
        rows = spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count()
        ids = lambda: set(spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().keys().mkString(",").split(",")) - {""}
        before = ids()
        held = module.stored(rows, "rows")
        seen.append(ids() - before)
        assert held.count() == 7 and spark.conf.get(C.CLEANUP, None) is None
    assert seen == [set(), set()], seen


def test_scores_hold_no_shuffled_words(spark):
    """The curve leaves the files of counts only; evidence has a shuffle of ratios and one of packs, the words' are gone."""
    docs, labels = toxic_docs(spark)
    before = shuffles(spark)
    nodes, _ = toxicity.train(docs, labels)
    trained = shuffles(spark) - before
    before = shuffles(spark)
    _, found = toxicity.with_evidence(docs.where("text is not null"), nodes, ["doc_id"])
    written = shuffles(spark) - before
    assert found.count() == 1500
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(trained) <= 2 and not written and plan.count("Exchange hashpartitioning") == 2, (trained, written, plan)
