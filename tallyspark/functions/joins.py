"""Join helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where a null key matches a null key.

    For joining aggregates back on their group columns: a null group is a
    group too, and must not vanish.  ``<=>`` is still planned as an
    equi-join (hash or sort-merge), not a nested loop.
    """
    if not keys:
        raise ValueError("join_keys needs at least one key")
    rk = {k: f"_rk_{i}" for i, k in enumerate(keys)}
    r = right.select(*[F.col(k).alias(rk[k]) for k in keys], *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[rk[k]]) for k in keys])
    return left.join(r, cond, how).drop(*rk.values())


#: Rows up to which a lookup table is broadcast.
BROADCAST_ROWS = 100_000


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for a broadcast join if it has at most ``rows`` rows (it is
    counted up to there), else unmarked: the join then shuffles both sides and
    Spark splits hot keys."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
