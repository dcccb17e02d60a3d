"""Run a query in Spark and its SQL in DuckDB over the same tables, and compare all rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    if hasattr(x, "isoformat"):
        return x.isoformat()
    if type(x).__name__ == "Decimal":
        return float(x)
    return list(map(plain, x)) if isinstance(x, list | tuple) else x


def rows_of(names: list[str], rows: list) -> tuple[list[str], list]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def duck_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    cur = con.execute(sql)
    return rows_of([d[0] for d in cur.description], cur.fetchall())


def differences(spark, query, sql: str, sf_dir: str) -> str:
    """Empty if both give the same rows under the same column names."""
    df = query(spark, sf_dir)
    names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    names2, want = duck_rows(sql, sf_dir)
    if names != names2:
        return f"columns {names} and {names2}"
    if got == want:
        return ""
    only = [g for g in got if g not in want][:3], [w for w in want if w not in got][:3]
    return f"{len(got)} and {len(want)} rows; only Spark {only[0]}; only SQL {only[1]}"
