"""Compares a query with its SQL in DuckDB: names, rows and values, whatever their order."""

import math
from decimal import Decimal
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        if Path(folder, f"{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def _plain(x):
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.5e}" if x else "0"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, int):
        return f"{float(x):.5e}" if x and abs(x) < 2**53 else "0" if not x else str(x)
    return repr(x)


def difference(df, con, sql: str) -> str:
    """Empty where both agree."""
    got_names = sorted(df.columns)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if got_names != sorted(names):
        return f"columns {got_names} and {sorted(names)}"
    want = sorted(tuple(_plain(r[names.index(n)]) for n in got_names) for r in result.fetchall())
    got = sorted(tuple(_plain(r[n]) for n in got_names) for r in df.collect())
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} of {len(got)} rows differ: {bad[:3]}" if bad else ""
