"""Order-insensitive comparison of a Spark result with the same query in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(value):
    """A value in a form that both engines share."""
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf_dir, query, sql):
    """Empty where both agree, else what differs."""
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    con = connect(sf_dir)
    try:
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        want = cur.fetchall()
    finally:
        con.close()
    if sorted(names) != sorted(df.columns):
        return f"columns: {sorted(df.columns)} instead of {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if len(a) != len(b):
        return f"{len(a)} rows instead of {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"{sorted(names)}: {x!r} instead of {y!r}"[:1500]
    return ""
