"""Connected components of a table of links, in rounds that grow with the
logarithm of the longest chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import table


def components(links: DataFrame) -> DataFrame:
    """id, comp: the smallest id that each linked id (columns a, b) can reach.

    In each round every id still in play moves to that of itself and its
    neighbours which comes first in a shuffled order, another for each round; its
    links move along, and links that become loops are dropped.  About half of
    the ids of any chain are first in no neighbourhood and go, whatever the
    ids' own order.  The rounds' moves are then followed from each id, and a component is named after
    its smallest id.  No step joins ids of one component with each other.  Links
    of an id with itself count for nothing; an empty table gives no rows.
    """
    steps = []
    edges = table(links.select("a", "b").filter("a <> b")
                  .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not edges.isEmpty():
        # xxhash64 maps the longs one to one, so no two ids tie
        order = F.xxhash64(F.col("b").bitwiseXOR(F.lit(len(steps) * 0x9E3779B97F4A7)))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ids = both.select(F.col("a").alias("id"), "b", order.alias("o"))
        near = ids.groupBy("id").agg(F.min_by("b", "o").alias("near"), F.min("o").alias("o"))
        own = F.xxhash64(F.col("id").bitwiseXOR(F.lit(len(steps) * 0x9E3779B97F4A7)))
        step = table(near.select("id", F.when(F.col("o") < own, F.col("near")).otherwise(F.col("id")).alias("to")), "step")
        steps.append(step)
        to = step.select(F.col("id").alias("a"), F.col("to").alias("a2"))
        moved = (edges.join(to, "a").select(F.col("a2").alias("a"), "b")
                 .join(to.select(F.col("a").alias("b"), F.col("a2").alias("b2")), "b")
                 .select("a", F.col("b2").alias("b")).filter("a <> b"))
        edges = table(moved.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if not steps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    place = steps[0].select("id", F.col("to").alias("at"))
    for step in steps[1:]:
        place = (place.join(step.select(F.col("id").alias("at"), "to"), "at", "left")
                 .select("id", F.coalesce("to", "at").alias("at")))
    place = table(place, "places")
    least = table(place.groupBy("at").agg(F.min("id").alias("comp")), "least")
    return table(place.join(least, "at").select("id", "comp"), "components")
