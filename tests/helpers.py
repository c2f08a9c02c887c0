"""Compare a Spark result with the SQL's, value by value, in any row order."""

from collections import Counter

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def value(v):
    if hasattr(v, "item"):
        v = v.item()
    try:
        if v is None or pd.isna(v):
            return "null"
    except (TypeError, ValueError):
        pass
    if isinstance(v, float) and v == int(v) and abs(v) < 1e15:
        v = int(v)
    return str(v)


def rows(frame):
    return Counter(tuple(value(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


def expected(sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con.sql(sql).df()


def same(df, sql, sf):
    got, want = df.toPandas(), expected(sql, sf)
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert a == b, (list((a - b).items())[:2], list((b - a).items())[:2])
