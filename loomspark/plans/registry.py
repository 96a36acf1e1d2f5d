"""All registered queries of the library proper."""

from __future__ import annotations

from loomspark.plans import answers, asking, audits, building, conflicts, evidence, naming, people, records, retrieval, structured, understanding

MODULES = (structured, answers, asking, audits, building, conflicts, evidence, naming, people, records, retrieval, understanding)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
