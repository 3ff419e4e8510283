"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

from tallyspark.session import scratch_path

#: Space and the five ASCII controls tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"
#: A run of other characters; possessive, so no backtracking.
WORD = r"[^\x20\x09-\x0D]++"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; other characters stay."""
    return F.translate(c, UPPER, LOWER)


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so that what
    follows neither recomputes it nor depends on an executor that is lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def one_per_id(df: DataFrame, key: str, cols: Sequence[str], text: str = "text", nameless: bool = False) -> DataFrame:
    """The named columns, one row per ``key``.

    Rows without a key are left out (no result could name them), unless
    ``nameless``; rows that repeat a key count as one document, the one with the
    greatest text (null smallest).  Only ids are shuffled to find out; texts are
    only if a key does repeat.
    """
    if nameless:
        named = one_per_id(df, key, cols, text)
        return named.unionByName(df.select(key, *cols).filter(F.col(key).isNull()))
    rows = df.select(key, *cols).filter(F.col(key).isNotNull())
    repeated = rows.groupBy(key).count().filter("count > 1")
    if repeated.isEmpty():
        return rows
    first = [text] if text in cols else []
    if not cols:
        return rows.distinct()
    best = F.max(F.struct(*(F.col(c) for c in [*first, *(c for c in cols if c not in first)])))
    return rows.groupBy(key).agg(best.alias("row")).select(key, *(F.col(f"row.{c}").alias(c) for c in cols))


#: Bytes of strings and numbers up to which a table is broadcast, whatever its rows.
BROADCAST_BYTES = 16 << 20


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row in memory: 16 a column, and the characters of what is
    not a number."""
    total = F.lit(16 * len(df.columns))
    for f in df.schema.fields:
        own = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (StringType, BinaryType)):
            total = total + F.coalesce(F.octet_length(own), F.lit(0))
        elif isinstance(f.dataType, (ArrayType, MapType, StructType)):
            total = total + F.octet_length(F.to_json(F.struct(own)))
    return total.cast("long")


def small_enough(df: DataFrame, rows: int, most: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows and about ``most`` bytes; stops
    counting at the row after."""
    found = df.limit(rows + 1).select(row_bytes(df).alias("b")).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    return found["n"] <= rows and found["b"] <= most


def hinted(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for a broadcast if it has at most ``rows`` rows and few bytes, else
    as it is (the join then shuffles both sides)."""
    return F.broadcast(df) if small_enough(df, rows) else df


def without(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` but those whose doc_id is in ``ids``; rows without one stay."""
    return df.join(hinted(ids.select(F.col("doc_id").alias("_gone")), 200_000), F.col("doc_id") == F.col("_gone"), "left_anti")
