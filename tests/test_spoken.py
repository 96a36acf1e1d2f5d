import os

import pytest

from loomspark.operators import lexical
from loomspark.plans import registry
from loomspark.sources import tables

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the test tables are not here")
def test_texts_once_and_no_entities_broadcast(spark, monkeypatch):
    """Each text is searched for once, however many questions have it, and no side of a join is broadcast uncounted."""
    searched, search = [], lexical.bm25
    monkeypatch.setattr(lexical, "bm25", lambda queries, *rest: searched.append(queries) or search(queries, *rest))
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 1)
    told = registry.queries()["spoken_answers"](spark, DIR)
    assert "Broadcast" not in told._jdf.queryExecution().executedPlan().toString()
    asked = [r.text for r in searched[0].collect()]
    assert len(asked) == len(set(asked)) > 1
