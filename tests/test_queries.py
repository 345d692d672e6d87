"""Registered queries next to their SQL twins. All of them with ALL_QUERIES=1."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare, connect

SOME = [
    "page_signals", "internal_links", "crawl_frontier", "robots_groups", "web_missing_og", "checks_passed",
    "config_warnings", "redirect_hops", "source_map_exposed", "classify_table_probe", "split_clauses", "intent_scan",
    "injection_override", "secret_source_line", "tables_without_rls", "guard_verdict_counts", "finding_prevalence",
    "audit_export_findings",
]
NAMES = list(queries()) if os.environ.get("ALL_QUERIES") else SOME


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, con, name):
    problem, _ = compare(spark, con, name, queries()[name], oracle_sql().get(name), sf)
    assert problem is None, problem


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_sql_twin_has_a_query():
    assert set(oracle_sql()) <= set(queries())
