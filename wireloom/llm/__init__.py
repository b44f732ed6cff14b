"""Operators of a training-data pipeline, their queries and, where SQL can say them, their oracles."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict = {}

_MODULES = ("url_filter", "near_dup", "decontaminate", "license_scan", "warc", "toxicity", "token_count", "sharding", "mixing", "quality_rules",
            "merkle", "simhash", "alignment")


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
        importlib.import_module(f"{__name__}.{mod}")
