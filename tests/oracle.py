"""Run a query and its SQL twin side by side and compare whole results."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (0.0 if value == 0 else value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda row: tuple((v is None, str(type(v)), str(v)) for v in row)
    return [columns[i] for i in order], sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=key)


def compare(df, con, sql) -> str | None:
    """None when equal, else a description of the first difference."""
    spark_cols, spark_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    duck_cols, duck_rows = rows_of([d[0] for d in result.description], result.fetchall())
    if spark_cols != duck_cols:
        return f"columns {spark_cols} vs {duck_cols}"
    if len(spark_rows) != len(duck_rows):
        extra = [r for r in spark_rows if r not in set(duck_rows)][:3]
        return f"row counts {len(spark_rows)} vs {len(duck_rows)}; only in spark {extra}"
    bad = [(a, b) for a, b in zip(spark_rows, duck_rows) if a != b]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None
