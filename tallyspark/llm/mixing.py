"""Mixing sources to target weights by Sainte-Laguë apportionment (operator 9)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import WORD, hinted, one_per_id, table, whole_text

WEIGHTS = (5, 2, 1)
REPEATS = 3
BLOCK = 16
SEED = "mix-1"
#: Words that a shard of a source holds on average, at least: many blocks, so that
#: what a shard's bound cuts from its last block is below 0.3 % of its words.
SHARD_WORDS = 1024


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def seeded(*parts: Column) -> Column:
    """A reproducible 60-bit number of its parts (md5), the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, target from rows (source, size).

    Sources in code point order, null last, get the weights in turn.  Targets
    share the total by weight, but stop at ``repeats`` times the source's size;
    what is over goes to the others by weight.  The level at which that ends is
    found from running sums over the sources in the order in which they fill
    up.  Its windows see one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)),
                               ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = ((F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
             / F.sum("weight").over(after))
    per = per.withColumn("cap", repeats * F.col("source_size")).withColumn("level", level)
    per = per.withColumn("place", F.row_number().over(fill))
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))).over(everything)
    per = per.withColumn("ends", first["level"])
    return per.select("source", "source_size",
                      F.least(F.col("cap").cast("double"), F.col("ends") * F.col("weight")).alias("target"))


def sainte_lague(cells: DataFrame, within: list[str], key: list[str], weight: str, seats: str) -> DataFrame:
    """``cells`` with ``quota``: the ``seats`` of each group ``within`` go, one
    by one, to the highest quotients weight / (2k + 1), k seats held so far;
    ties by ``key``.

    Only quotients that can decide are listed.  Rounding weight / (total /
    seats) is wrong by at most half a seat a cell, so the divisor that fits
    moves a cell by no more than its share of half the number of cells, and one;
    seats below that band are certain, seats above it impossible.  A group costs
    a few rows per cell, whatever its number of seats.
    """
    whole = Window.partitionBy(*within)
    share = F.when(F.col("_all") > 0, F.col(weight) / F.col("_all")).otherwise(F.lit(0.0))
    cells = cells.withColumn("_all", F.sum(F.col(weight).cast("double")).over(whole))
    cells = cells.withColumn("_n", F.count("*").over(whole)).withColumn("_share", share)
    band = (F.ceil(F.col("_share") * F.col("_n") / 2) + 1).cast("long")
    near = F.floor(F.col("_share") * F.col(seats) + 0.5).cast("long")
    cells = cells.withColumn("_low", F.greatest(near - band, F.lit(0).cast("long"))).withColumn("_high", near + band)
    cells = cells.withColumn("_open", F.col(seats) - F.sum("_low").over(whole))
    order = Window.partitionBy(*within).orderBy(F.col("_quotient").desc(), *(x for k in key for x in (F.col(k).isNull(), F.col(k))), "_k")
    ranked = (cells.withColumn("_k", F.explode(F.sequence("_low", F.col("_high") - 1)))
              .withColumn("_quotient", F.col(weight) / (2 * F.col("_k") + 1))
              .withColumn("_got", (F.row_number().over(order) <= F.col("_open")) & (F.col(weight) > 0)))
    kept = [c for c in cells.columns if not c.startswith("_")]
    return ranked.groupBy(*kept, "_low").agg(F.sum(F.col("_got").cast("long")).alias("_more")).select(
        *kept, (F.col("_low") + F.col("_more")).alias("quota"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, block: int = BLOCK, seed: str = SEED,
                shards: int | None = None) -> DataFrame:
    """How many words of each document the mix takes.

    Blocks of ``block`` words are apportioned to the sources by their targets,
    and those of a source to its shards (documents dealt by a seeded hash) by
    the words they hold, both by highest quotients, so that each shard has an
    integer quota.  A shard's documents in seeded order are one stream of words,
    cut in blocks; the quota takes whole rounds of the stream and then the
    blocks at its front.  A shard never takes more than ``repeats`` rounds, so no
    document does.  ``shards`` a source grow with the square root of the rows,
    so a source with a third of them is numbered by many tasks, but a source has no
    more than one for each ``SHARD_WORDS`` of its words: its shards hold many blocks, and
    bounding a shard costs it less than one block.

    Returns doc_id, source, size, source_size, target, taken.  Null text has no
    words and takes none; null is a source of its own; with no words at all
    every target is 0.  Rows without an id are left out, rows that repeat one
    count once; an empty table gives no rows.  Same rows and seed, same result.
    """
    sized = table(one_per_id(docs, "doc_id", ["source", "text"]).select(
        "doc_id", "source", n_words(whole_text()).alias("size")), "sized")
    if shards is None:
        shards = max(1, math.isqrt(sized.count()) // 10)
    targets = source_targets(sized, weights, repeats)
    total = F.sum("source_size").over(Window.partitionBy())
    targets = targets.withColumn("_one", F.lit(1)).withColumn("blocks", F.round(total / block).cast("long"))
    by_source = sainte_lague(targets, ["_one"], ["source"], "target", "blocks").select(
        "source", "source_size", "target", F.col("quota").alias("blocks"))
    own = sized.groupBy("source").agg(F.greatest(F.lit(1), F.least(F.lit(shards), F.expr(f"sum(size) div {SHARD_WORDS}")))
                                      .cast("long").alias("shards"))
    own = hinted(table(own, "shards").select(F.col("source").alias("_source"), "shards"), 100_000)
    dealt = sized.join(own, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    dealt = dealt.withColumn("shard", seeded(F.lit(seed), F.lit("shard"), F.col("doc_id").cast("string")) % F.col("shards")).drop("shards")
    cells = dealt.groupBy("source", "shard").agg(F.sum("size").alias("held")).alias("c")
    cells = cells.join(by_source.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).select(
        "c.*", "source_size", "target", "blocks")
    quotas = sainte_lague(cells, ["source"], ["shard"], "held", "blocks").select(
        F.col("source").alias("q_source"), F.col("shard").alias("q_shard"), "held", "source_size", "target",
        F.least(F.col("quota") * block, repeats * F.col("held")).alias("words"))
    joined = dealt.join(quotas, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard")))
    stream = Window.partitionBy("source", "shard").orderBy("draw", "doc_id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    draw = seeded(F.lit(seed), F.lit("draw"), F.col("doc_id").cast("string"))
    joined = joined.withColumn("draw", draw).withColumn("upto", F.sum("size").over(stream))
    rounds = F.when(F.col("held") > 0, F.expr("words div held")).otherwise(F.lit(0).cast("long"))
    rest = F.col("words") - rounds * F.col("held") - (F.col("upto") - F.col("size"))
    zero = F.lit(0).cast("long")
    return joined.select("doc_id", "source", "size", "source_size", "target",
                         (rounds * F.col("size") + F.greatest(zero, F.least(rest, F.col("size")))).alias("taken"))


def take(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: documents of which it takes no word go;
    the text of the others is repeated as often as taken, parted by a line
    break, the last time only its first words if the quota ends inside it (once
    a shard).  n_chars follows the new text; other columns stay."""
    cols = docs.columns
    picked = plan.filter("taken > 0").select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"),
                                             F.col("taken").alias("_taken"))
    rows = one_per_id(docs, "doc_id", [c for c in cols if c != "doc_id"]).join(picked, F.col("doc_id") == F.col("_id"))
    rounds, part = F.expr("int(_taken div _size)"), F.expr("int(_taken % _size)")
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), part), " ")
    pieces = F.concat(F.array_repeat(F.col("text"), rounds), F.when(part > 0, F.array(head)).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("text", F.array_join(pieces, "\n"))
    if "n_chars" in cols:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*cols)
