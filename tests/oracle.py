"""Runs a query and its SQL and compares the rows."""

from __future__ import annotations

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def compare(spark: SparkSession, sf: str, f, sql: str) -> str:
    """Empty if the rows are equal, else what differs."""
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.sql(sql)
    cols = sorted(rel.columns)
    want = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    df = f(spark, sf)
    if sorted(df.columns) != cols:
        return f"columns {sorted(df.columns)} and {cols}"
    key = lambda r: tuple(str(r[c]) for c in cols)
    a, b = sorted(key(r.asDict()) for r in df.collect()), sorted(key(r) for r in want)
    if a == b:
        return ""
    left, right = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return f"{len(a)} rows and {len(b)}; only here {left}; only in SQL {right}"
