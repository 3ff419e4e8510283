"""Query registry: key -> (Spark callable over an sf folder, DuckDB oracle SQL).

Each registered callable takes ``(spark, sf_dir)`` and returns a lazy
DataFrame over the whole driver tables.  The oracle SQL computes the same
result in DuckDB over the same tables (``None`` = no SQL form; the driver then
checks rows only and unit tests carry correctness).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Entry:
    key: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    note: str = ""


REGISTRY: dict[str, Entry] = {}


def register(key: str, sql: str | None = None, note: str = ""):
    def deco(fn):
        if key in REGISTRY:
            raise KeyError(f"duplicate query key {key}")
        REGISTRY[key] = Entry(key, fn, sql, note)
        return fn
    return deco


MODULES = ("queries_agree", "queries_metrics", "queries_codes", "queries_relate", "queries_text", "queries_sample",
           "queries_vehicle", "queries_io", "queries_ml")


def load_all() -> dict[str, Entry]:
    """Import every module that registers queries; one that is missing raises."""
    for mod in MODULES:
        import_module(f"tallyspark.plans.{mod}")
    return REGISTRY
