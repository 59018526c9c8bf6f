"""Queries of every operator on the given tables, each with the SQL that must give the same result."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ["calendar", "files", "columns", "joins", "aggregates", "trends", "curves", "ranks", "sets", "scalars",
           "cells", "emissions", "incremental", "rules", "changes", "tables", "readouts"]


def entries() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    out = {}
    for name in MODULES:
        found = import_module(f"catalog.{name}").QUERIES
        clash = out.keys() & found.keys()
        if clash:
            raise ValueError(f"query names used twice: {sorted(clash)}")
        out.update(found)
    return out
