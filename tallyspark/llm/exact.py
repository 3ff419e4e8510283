"""Exact deduplication by progressive refinement (operator 5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import WHITE, one_per_id, table, whole_text

PREFIX_CHARS = 256


def normalised(name: str = "text"):
    """The text without white space; null counts as empty."""
    return reduce(lambda c, w: F.replace(c, F.lit(w), F.lit("")), WHITE, whole_text(name))


def _shared(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys occur more than once (partial counts before the shuffle;
    as a table of their own, so that Spark splits the join where a key is hot)."""
    twice = table(df.groupBy(*keys).count().filter("count > 1").drop("count"), "twice")
    return df.join(twice, list(keys), "left_semi")


def exact_dedup(docs: DataFrame, prefix_chars: int = PREFIX_CHARS, every_hash: bool = False) -> DataFrame:
    """Which document of each group of equal texts stays.

    Texts are equal when identical without white space.  Rows are compared by
    normalised length, those that share one by the hash of a prefix, and only
    those that share that too by the SHA-256 of the whole normalised text.  Of
    equal texts the row with the most code points in its original text stays,
    then the smallest id.

    Returns doc_id, keep_id, group_size, kept, and text_sha256, which is null
    for rows whose whole text had not to be read, unless ``every_hash`` asks for it: every
    text is then hashed, once, in one pass, and only rows that survive are grouped by their hash.  Null text counts as empty;
    all empty texts are one group.  Rows without an id are left out, rows that
    repeat one count once (see ``one_per_id``); an empty table gives no rows.
    """
    rows = one_per_id(docs, "doc_id", ["text"])
    norm = normalised()
    sizes = table(rows.select("doc_id", F.length(whole_text()).alias("points"), F.length(norm).alias("size"),
                              F.xxhash64(F.substring(norm, 1, prefix_chars)).alias("prefix")), "sizes")
    left = table(_shared(_shared(sizes, "size"), "size", "prefix").select("doc_id", "points"), "survivors")
    sha = F.sha2(norm, 256).alias("text_sha256")
    hashed = rows.select("doc_id", F.length(whole_text()).alias("points"), sha)
    if every_hash:  # the join then moves hashes, not texts
        hashed = table(hashed, "hashed")
        full = hashed.join(left.select("doc_id"), "doc_id", "left_semi")
    else:
        full = table(rows.join(left, "doc_id").select("doc_id", "points", sha), "full")
    groups = table(full.groupBy("text_sha256").agg(
        F.min(F.struct(-F.col("points"), "doc_id"))["doc_id"].alias("keep_id"), F.count("*").alias("group_size")), "groups")
    found = full.join(groups, "text_sha256").select(
        "doc_id", "keep_id", "group_size", (F.col("keep_id") == F.col("doc_id")).alias("kept"), "text_sha256")
    lone = (hashed if every_hash else sizes).join(left.select("doc_id"), "doc_id", "left_anti")
    return found.unionByName(lone.select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        F.col("text_sha256") if every_hash else F.lit(None).cast("string").alias("text_sha256")))
