"""Run a query in Spark and its SQL in DuckDB, compare rows regardless of order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def norm(v):
    if v is None:
        return ("", "null")
    if isinstance(v, bool):
        return ("b", str(v))
    if isinstance(v, float):
        if math.isnan(v):
            return ("f", "nan")
        return ("f", repr(v + 0.0 if v != 0 else 0.0))
    if isinstance(v, (list, tuple)):
        return ("l", str([norm(x) for x in v]))
    if hasattr(v, "isoformat"):
        return ("d", v.isoformat())
    if type(v).__name__ == "Decimal":
        return ("f", repr(float(v)))
    if isinstance(v, int):
        return ("i", str(v))
    return ("s", str(v))


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows), [cols[i] for i in order]


def close_rows(a, b):
    """Equal rows up to the last rounded digit of their floats."""
    def near(x, y):
        if x[0] == y[0] == "f" and "nan" not in (x[1], y[1]):
            return math.isclose(float(x[1]), float(y[1]), rel_tol=1e-7, abs_tol=2e-4)
        return x == y

    return all(near(x, y) for x, y in zip(a, b))


def differences(spark_df, con, sql, tolerant=False):
    """List of problems, empty when both sides agree.

    ``tolerant`` lets floats differ by summation order next to a rounding edge.
    """
    s_rows, s_cols = rows_of(spark_df.columns, spark_df.collect())
    rel = con.execute(sql)
    d_cols = [c[0] for c in rel.description]
    d_rows, d_cols = rows_of(d_cols, rel.fetchall())
    out = []
    if s_cols != d_cols:
        out.append(f"columns {s_cols} != {d_cols}")
        return out, len(s_rows)
    if len(s_rows) != len(d_rows):
        out.append(f"row count {len(s_rows)} != {len(d_rows)}")
    if not s_rows:
        out.append("no rows")
    if s_rows != d_rows:
        if tolerant:
            plain = lambda r: ([x for x in r if x[0] != "f"], r)
            s_rows, d_rows = sorted(s_rows, key=plain), sorted(d_rows, key=plain)
        bad = [(a, b) for a, b in zip(s_rows, d_rows) if a != b and not (tolerant and close_rows(a, b))]
        for a, b in bad[:2]:
            out.append("first differences: " + str([(c, x, y) for c, x, y in zip(s_cols, a, b) if x != y][:4]))
        if bad:
            out.append(f"{len(bad)} rows differ")
    return out, len(s_rows)
