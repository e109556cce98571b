"""Comparing a query with its SQL counterpart in DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, float):
        return (2, "nan" if math.isnan(value) else repr(round(value, 6) + 0.0))
    if hasattr(value, "dtype"):
        value = value.item()
        return _cell(value)
    return (3, f"{type(value).__name__}:{value}")


def normalised(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted([tuple(_cell(row[k]) for k in order) for row in rows])


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else a description of the first difference."""
    got_cols, got = normalised(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = con.execute(sql)
    wide = [d[0] for d in result.description if str(d[1]).split("(")[0] in ("HUGEINT", "DECIMAL")]
    if wide:
        return f"SQL columns {wide} need a cast to BIGINT or DOUBLE"
    want_cols, want = normalised([d[0] for d in result.description], result.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"{a} != {b}"
    return None
