"""Registered queries: one Spark callable per name, and its SQL where there is one."""

from __future__ import annotations

import functools
import importlib

from quire.session import tune

AREAS = ["text", "pii", "search", "redaction", "catalog", "compare", "usage",
         "records", "media", "extraction", "streams"]


def tuned(fn):
    """A query that sets what the plans rely on before it runs."""

    @functools.wraps(fn)
    def run(spark, sf_dir):
        return fn(tune(spark), sf_dir)

    return run


def all_queries() -> dict:
    found = {}
    for area in AREAS:
        found.update(importlib.import_module(f"quire.queries.{area}").QUERIES)
    return {name: tuned(fn) for name, fn in found.items()}


def all_sql() -> dict:
    found = {}
    for area in AREAS:
        found.update(importlib.import_module(f"quire.queries.{area}").SQL)
    return found
