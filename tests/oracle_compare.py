"""Run a catalog query in Spark and its oracle SQL in DuckDB; compare as multisets."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [tuple(_norm(r[i]) for i in order) for r in rows], [columns[i] for i in order]


def compare(spark, con, sf_dir: str, name: str, query, sql: str) -> dict:
    sdf = query(spark, sf_dir)
    s_rows = [tuple(r) for r in sdf.collect()]
    s_rows, s_cols = rows_of(sdf.columns, s_rows)
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows, d_cols = rows_of(d_cols, res.fetchall())
    out = {"name": name, "spark_rows": len(s_rows), "oracle_rows": len(d_rows),
           "columns_match": s_cols == d_cols, "spark_cols": s_cols, "oracle_cols": d_cols}
    cs, cd = Counter(s_rows), Counter(d_rows)
    out["values_match"] = cs == cd
    if cs != cd:
        out["only_spark"] = list((cs - cd).elements())[:3]
        out["only_oracle"] = list((cd - cs).elements())[:3]
    return out
