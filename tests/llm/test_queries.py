"""Registered queries next to their SQL, on the smallest tables."""

import pytest

from riskloom.llm.queries import QUERIES, SQL
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    problem, count = compare(spark, connect(sf), name, QUERIES[name], SQL.get(name), sf)
    assert problem is None, problem
    assert count > 0


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
