"""Comparison of a query's rows with those of its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    out = []
    for r in df.itertuples(index=False, name=None):
        out.append(tuple("null" if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>") else f"{float(v):.9g}" if isinstance(v, float) or type(v).__name__ in ("Decimal", "float64") else str(v) for v in r))
    return sorted(out)


def check(spark, sf_dir, query, sql):
    got, want = query(spark, sf_dir).toPandas(), connect(sf_dir).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    return got
