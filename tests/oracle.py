"""Runs registered queries next to their SQL twins in DuckDB. Also a command line tool."""

from __future__ import annotations

import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _canon(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float) and value.is_integer():
        return int(value)
    if isinstance(value, list):
        return tuple(_canon(v) for v in value)
    return str(value) if not isinstance(value, (int, float, str)) else value


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr(tuple(_canon(r[i]) for i in order)) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    """``(problem or None, row count)``."""
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return None, len(got)
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    want = rel.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(cols)}", len(got)
    a, b = _rows(df.columns, got), _rows(cols, want)
    if a == b:
        return None, len(got)
    only_a = [x for x in a if x not in set(b)][:3]
    only_b = [x for x in b if x not in set(a)][:3]
    return f"{len(a)} vs {len(b)} rows\n   spark {only_a}\n   sql   {only_b}", len(got)


def main(names: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from __spark_entry__ import oracle_sql, queries
    from riskloom import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(
        "oracle", master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls, bad = oracle_sql(), 0
    for name, fn in queries().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            problem, count = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001
            problem, count = f"{type(exc).__name__}: {str(exc)[:700]}", -1
        bad += problem is not None or count <= 0
        mark = "BAD " if problem else ("EMPTY " if count == 0 else "ok  ")
        print(f"{mark}{name} rows={count} {'sql' if name in sqls else 'rows-only'} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
