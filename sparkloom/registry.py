"""All queries over the reference's operators, and their oracle SQL."""

from __future__ import annotations

from sparkloom.plans import adapter
from sparkloom.plans.catalog import from_test_tables
from sparkloom.queries import graph, history, relational, text

MODULES = (relational, history, graph, text)


def queries() -> dict:
    """name -> function of (spark, sf_dir)."""
    return {name: (lambda spark, sf_dir, f=f: f(from_test_tables(spark, sf_dir))) for m in MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: adapter.sql(sql) for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
