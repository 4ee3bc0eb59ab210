"""Run a Spark query and its reference SQL on the same tables and compare rows."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        path = f"{sf_dir}/{table}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return bool(value)
    if isinstance(value, float):
        return ("f", round(value, 9) + 0.0)
    return value


def rows_of(cursor_rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in cursor_rows]
    return sorted(out, key=repr)


def differences(spark_df, con, sql: str) -> str | None:
    """None if equal, else a short description."""
    got_columns = spark_df.columns
    got = rows_of([tuple(r) for r in spark_df.collect()], got_columns)
    cur = con.execute(sql)
    want_columns = [d[0] for d in cur.description]
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} != {sorted(want_columns)}"
    want = rows_of(cur.fetchall(), want_columns)
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:2]
        return f"{len(got)} rows != {len(want)}; only here {extra}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}" if bad else None
