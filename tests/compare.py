"""Compares a query's rows with those of its reference SQL, as multisets of normalised values."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, datetime.datetime) and x.time() == datetime.time():
        return x.date()
    return x


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str) -> str:
    """An empty text if both give the same rows under the same column names."""
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    expected, found = rows_of(names, cursor.fetchall()), rows_of(df.columns, df.collect())
    if expected == found:
        return ""
    return f"{sum(found.values())} rows against {sum(expected.values())}; only here {list((found - expected).items())[:2]}; only there {list((expected - found).items())[:2]}"
