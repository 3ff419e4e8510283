"""Deterministic hashes that give the same value in Spark SQL and DuckDB.

``H(k, s)`` = the first 32 bits of ``md5(str(k) || '|' || s)`` as an integer.
It drives the test views, exact-k sampling and splits, so a seed reproduces
the same rows on any cluster size and in the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _salt_col(salt) -> Column:
    if isinstance(salt, Column):
        return F.concat(F.lit("|"), salt)
    return F.lit("|" + str(salt))


def hash32(key, salt) -> Column:
    """32-bit md5 prefix of ``key || '|' || salt`` as BIGINT (0 .. 2^32-1)."""
    key = key if isinstance(key, Column) else F.col(key)
    digest = F.md5(F.concat(key.cast("string"), _salt_col(salt)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def sql_hash32(key_sql: str, salt_sql: str) -> str:
    """DuckDB text of :func:`hash32`; ``salt_sql`` is an SQL string expression."""
    return (f"CAST('0x' || substr(md5(CAST({key_sql} AS VARCHAR) || '|' || {salt_sql}), 1, 8)"
            f" AS BIGINT)")


def pick(h: Column, values: list) -> Column:
    """``values[h % len(values)]`` as a column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (h % len(values) + 1).cast("int"))


def sql_pick(h_sql: str, values: list) -> str:
    lits = ", ".join(repr(v) if isinstance(v, str) else str(v) for v in values)
    return f"([{lits}])[({h_sql}) % {len(values)} + 1]"
