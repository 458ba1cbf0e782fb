"""Every registered query with its oracle."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

MODULES = ("stats", "places", "rasters", "series", "networks", "models", "texts", "files", "stores", "trees", "streams")
QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function (spark, sf_dir) under its name, with the DuckDB SQL for the same rows where there is one."""

    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def load() -> None:
    for name in MODULES:
        import_module(f"lithos.plans.{name}")


def queries() -> dict:
    load()
    return dict(QUERIES)


def oracles() -> dict:
    load()
    return dict(ORACLES)
