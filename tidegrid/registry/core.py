"""Registry of runnable queries, each with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bindings import CTES, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
COVERS: dict[str, str] = {}


def with_ctes(body: str) -> str:
    """Put the shared table definitions that a query names in front of it."""
    names = list(CTES)
    used: list[str] = []

    def visit(text: str) -> None:
        for n in names:
            if n not in used and re.search(rf"\b{n}\b", text):
                visit(CTES[n])
                if n not in used:
                    used.append(n)

    visit(body)
    if not used:
        return body
    head = ", ".join(f"{n} AS ({CTES[n]})" for n in used)
    body = body.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head}, {body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {head}, {body[5:]}"
    return f"WITH {head} {body}"


def query(name: str, covers: str, sql: str | None = None, doubles: str = "", digits: int = 6):
    """Register a query. Columns in ``doubles`` are rounded alike on both sides; ``name:n`` sets the digits."""
    cols = {c.split(":")[0]: int(c.split(":")[1]) if ":" in c else digits for c in doubles.split()}

    def wrap(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(Tables(spark, sf_dir))
            return df.withColumns({c: F.round(c, n) for c, n in cols.items()}) if cols else df

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        COVERS[name] = covers
        if sql is not None:
            body = with_ctes(sql)
            if cols:
                reps = ", ".join(f"round({c}, {n}) AS {c}" for c, n in cols.items())
                body = f"SELECT * REPLACE ({reps}) FROM ({body})"
            SQL[name] = body
        return fn

    return wrap
