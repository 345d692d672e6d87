"""Registered queries and their SQL twins.

A query is a function ``(spark, sf_dir) -> DataFrame``. Its SQL names shared table expressions
freely; the ones it uses, and the ones those use, are added as a WITH clause.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
EXPRESSIONS: dict[str, str] = {}


def expression(name: str, sql: str) -> None:
    """A named table expression other SQL can select from."""
    assert name not in EXPRESSIONS, name
    EXPRESSIONS[name] = sql


@lru_cache(maxsize=None)
def _used(sql: str) -> list[str]:
    """Expressions named in a text; only called once every expression is registered."""
    words = set(re.findall(r"\b[a-z_][a-z0-9_]*\b", _without_literals(sql)))
    return [name for name in EXPRESSIONS if name in words]


def _without_literals(sql: str) -> str:
    return re.sub(r"'(?:[^']|'')*'", "''", sql)


def with_expressions(sql: str) -> str:
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in _used(text):
            if name not in ordered:
                visit(EXPRESSIONS[name])
                if name not in ordered:
                    ordered.append(name)

    visit(sql)
    if not ordered:
        return sql
    body = ",\n".join(f"{n} AS MATERIALIZED ({EXPRESSIONS[n]})" for n in ordered)
    return f"WITH {body}\n{sql}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return register


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({columns})"


@lru_cache(maxsize=1)
def _all_oracles() -> dict[str, str]:
    return {name: with_expressions(sql) for name, sql in _SQL.items()}


def oracles() -> dict[str, str]:
    """The SQL twins with the expressions they use written out."""
    return dict(_all_oracles())


def oracle_of(name: str) -> str:
    """The SQL of a query without its shared expressions, for use inside another query."""
    return _SQL[name]
