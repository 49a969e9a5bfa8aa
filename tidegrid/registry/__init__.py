"""Queries over the given tables, one or more per operator, with equivalent SQL."""

from importlib import import_module

from .core import COVERS, QUERIES, SQL

FAMILIES = ["scalars", "sources", "joins", "aggregates", "windows", "reshape", "spatial", "effort", "scenarios", "risk", "logbook", "features", "stats"]


def _load():
    for f in FAMILIES:
        import_module(f"{__name__}.{f}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_sql():
    _load()
    return dict(SQL)


def coverage():
    _load()
    return dict(COVERS)
