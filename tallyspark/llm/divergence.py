"""Which terms and sources of a language set its sources apart (operator 12)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import hinted, table

#: Documents of a language that a kept term is in, at least.
MIN_DOCS = 30
#: Added to every count.
SMOOTH = 5
#: What probabilities are counted in.
UNIT = 1_000_000_000
#: Ranks of the term report (a top-k report).
TOP = 50
#: Distinct terms a task holds before it passes their counts on.
HELD_TERMS = 200_000

#: Bytes of terms as they are or lower-cased, all others as a space.  Every byte
#: of a character beyond ASCII belongs to a term, so bytes can stand for characters.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str) -> list[bytes]:
    """The terms of a text in order: runs of A-Z, a-z and characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it); counted
    within tasks first, in tables of bounded size, and then added up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, df) in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()),
                     pa.array([t.decode("utf-8", "replace") for t in n], pa.string()),
                     pa.array(n.values(), pa.int64()), pa.array([df[t] for t in n], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                own = Counter(terms(text))
                n, df = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                for t, k in own.items():
                    n[t] += k
                df.update(own.keys())
                size += len(n) - before
                if size >= HELD_TERMS:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    found = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _p(count: str, total: str) -> F.Column:
    """1 + floor(UNIT * (count + SMOOTH) / (total + SMOOTH * V)), exact at any count."""
    return F.expr(f"1 + (cast({UNIT} as decimal(10,0)) * cast({count} + {SMOOTH} as decimal(20,0))) "
                  f"div cast({total} + {SMOOTH} * v as decimal(20,0))")


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """How far the sources of a language are from one another, and by which terms.

    Terms are counted per (lang, source); a language keeps its ``v`` terms in at
    least ``min_docs`` of its documents.  A kept term's share in a group is
    p = 1 + floor(10^9 * (count + 5) / (N + 5 * v)), N the group's occurrences of
    kept terms; all arithmetic is on whole numbers.

    * part ``term``: kept terms that the group has, with a greater share than in the whole
      language (q).  Terms are grouped into cells by (group count, language count);
      p - q is evaluated once per cell, cells of equal value are merged, the merged cells are ranked
      by value with the running sum of their terms, and only those that begin
      before rank ``top`` are expanded, in UTF-8 order of their terms.
    * part ``pair``: the group against each other source of its language, the sum of
      abs(p - q) over all kept terms.  Terms of one side only are summed from the
      cells of that side's counts (the other count is 0); terms of neither are one
      cell; terms that both have are joined.

    Returns lang, source, part, item, value, rank (from 1 per group and part, value
    descending, item ascending by its UTF-8 bytes).  Every row is a document, also
    rows that repeat an id; null text, lang and source are ''.  A group without
    kept terms has pairs but no terms; a language of one source has no pairs; an
    empty table gives no rows.  Other columns are not read.
    """
    g = ["lang", "source"]
    counts = table(term_counts(docs), "counts")
    kept = (counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs"))
            .filter(F.col("docs") >= min_docs).select("lang", "term", "all_n"))
    kept = table(kept, "kept")
    own = table(counts.select(*g, "term", "n").join(kept, ["lang", "term"]), "own")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("all_total"))
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in g)).distinct()
    groups = (groups.join(own.groupBy(*g).agg(F.sum("n").alias("total")), g, "left").join(langs, "lang", "left")
              .select(*g, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "v", "all_total"))))
    groups = table(groups, "groups")
    return _terms(own, groups, top).unionByName(_pairs(own, groups))


def _terms(own: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    g = ["lang", "source"]
    cells = own.groupBy(*g, "n", "all_n").agg(F.count("*").alias("m"))
    value = cells.join(hinted(groups, 100_000), g).withColumn("value", _p("n", "total") - _p("all_n", "all_total"))
    value = table(value.filter("value > 0").select(*g, "n", "all_n", "m", "value"), "cells")
    merged = value.groupBy(*g, "value").agg(F.sum("m").alias("m"))
    by_value = Window.partitionBy(*g).orderBy(F.col("value").desc())
    # each merged cell has a term at least, so ``top`` of them are enough
    merged = merged.withColumn("place", F.row_number().over(by_value)).filter(F.col("place") <= top)
    before = F.sum("m").over(by_value.rowsBetween(Window.unboundedPreceding, -1))
    chosen = merged.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < top).select(*g, "value")
    wanted = value.join(chosen, [*g, "value"], "left_semi").select(*g, "n", "all_n", "value")
    rows = own.join(wanted, [*g, "n", "all_n"])
    rank = F.row_number().over(Window.partitionBy(*g).orderBy(F.col("value").desc(), "term"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= top).select(
        *g, F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def _pairs(own: DataFrame, groups: DataFrame) -> DataFrame:
    """Sums over both sides' terms, from cells where one side has none."""
    g = ["lang", "source"]
    zero = groups.filter("v > 0").withColumn("c0", F.lit(0).cast("long"))
    zero = zero.select(*g, "v", "total", _p("c0", "total").alias("p0"))
    small = hinted(zero, 100_000)
    side = table(own.join(small, g).select(*g, "term", "n", _p("n", "total").alias("p"), "p0"), "shares")
    # all terms of a group against a source that has none of them, cell by cell
    cells = table(side.groupBy(*g, "p").agg(F.count("*").alias("m")), "sides")
    other = small.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    alone = (cells.join(other, "lang").filter("source <> item").groupBy(*g, "item")
             .agg(F.sum(F.col("m") * F.abs(F.col("p") - F.col("q0"))).alias("alone"), F.sum("m").alias("held")))
    # terms that both have: their own difference, and what the cells above counted for them
    a = side.select("lang", "term", "source", "p", "p0")
    b = side.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    both = (a.join(b, ["lang", "term"]).filter("source < item").groupBy(*g, "item")
            .agg(F.count("*").alias("both"), F.sum(F.abs(F.col("p") - F.col("q"))).alias("apart"),
                 F.sum(F.abs(F.col("p") - F.col("q0")) + F.abs(F.col("q") - F.col("p0"))).alias("counted")))
    both = table(both, "both")
    # one row per ordered pair
    pair = groups.select(*g, "v").join(
        hinted(groups.select("lang", F.col("source").alias("item")), 100_000), "lang").filter("source <> item")
    pair = pair.withColumn("x", F.least("source", "item")).withColumn("y", F.greatest("source", "item"))
    bases = zero.select("lang", "source", "p0")
    pair = (pair.join(bases, g, "left").join(bases.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0")),
                                             ["lang", "item"], "left"))
    mine = alone.select(*g, "item", "alone", "held")
    theirs = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"),
                          F.col("alone").alias("alone_b"), F.col("held").alias("held_b"))
    pair = (pair.join(mine, [*g, "item"], "left").join(theirs, [*g, "item"], "left")
            .join(both.select("lang", F.col("source").alias("x"), F.col("item").alias("y"), "both", "apart", "counted"),
                  ["lang", "x", "y"], "left"))
    z = {c: F.coalesce(c, F.lit(0)) for c in ("alone", "alone_b", "held", "held_b", "both", "apart", "counted", "p0", "q0")}
    neither = F.col("v") - (z["held"] + z["held_b"] - z["both"])
    value = z["alone"] + z["alone_b"] - z["counted"] + z["apart"] + neither * F.abs(z["p0"] - z["q0"])
    rank = F.row_number().over(Window.partitionBy(*g).orderBy(F.col("value").desc(), "item"))
    return (pair.select(*g, "item", value.cast("long").alias("value")).withColumn("rank", rank)
            .select(*g, F.lit("pair").alias("part"), "item", "value", "rank"))
