"""Registry of runnable queries and the oracle SQL each is compared with."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict = {}

_MODULES = ("ingest", "filters", "claims", "scoring", "search", "events", "digest", "enrich", "themes", "topics",
            "quality", "stream", "plans")


def register(name: str, sql: str | None = None):
    """Decorator: add a ``(spark, sf_dir) -> DataFrame`` query and, when SQL can say it, its oracle."""

    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def load() -> None:
    for mod in _MODULES:
        try:
            importlib.import_module(f"{__name__}.{mod}")
        except ModuleNotFoundError as exc:
            if exc.name != f"{__name__}.{mod}":
                raise
