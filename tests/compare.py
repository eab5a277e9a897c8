"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import decimal
import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return v
    if isinstance(v, bool):
        return int(v)
    return v


def _key(row):
    return tuple((0, "") if v is None else (1, str(v)) if isinstance(v, str) else (1, repr(v)) for v in row)


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, [tuple(_norm(r[c]) for c in cols) for r in df.collect()]


def rows_of_duck(con, sql):
    rel = con.sql(sql)
    names = rel.columns
    cols = sorted(names)
    idx = [names.index(c) for c in cols]
    return cols, [tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()]


def compare(df, con, sql, rel_tol=1e-9, strict=False):
    sc, sr = rows_of_spark(df)
    dc, dr = rows_of_duck(con, sql)
    problems = []
    if sc != dc:
        problems.append(f"columns differ: spark={sc} duck={dc}")
        return problems
    if len(sr) != len(dr):
        problems.append(f"row count spark={len(sr)} duck={len(dr)}")
    sr = sorted(sr, key=_key)
    dr = sorted(dr, key=_key)
    bad = 0
    for a, b in zip(sr, dr):
        for c, x, y in zip(sc, a, b):
            same = x == y or (not strict and isinstance(x, float) and isinstance(y, float)
                              and math.isclose(x, y, rel_tol=rel_tol, abs_tol=1e-12))
            if not same:
                bad += 1
                if bad <= 5:
                    problems.append(f"col {c}: spark={x!r} duck={y!r} row spark={a} duck={b}")
    if bad:
        problems.append(f"{bad} differing cells")
    return problems
