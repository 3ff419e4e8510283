"""Benchmark decontamination over a positional inverted index (operator 10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import ascii_lower, hinted, one_per_id, table, whole_text

WINDOW = 13
#: Terms of a window whose postings are intersected, the rarest first.
RAREST = 3
#: Rows up to which benchmark tables are broadcast (if they are also few bytes);
#: above, the joins shuffle.  Places found grow with the documents and repeat their
#: phrases, so their files say little of their size: they are merged, never broadcast.
BROADCAST_ROWS = 200_000
#: What parts words: all ASCII but digits and, in lower-cased text, a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]++"


def pieces(text: Column) -> Column:
    """The words of a text in order; the first and the last piece are empty where
    the text begins or ends with a separator, so a word's number is its place
    plus the same for the whole text."""
    return F.split(ascii_lower(text), BETWEEN)


def terms(text: Column) -> Column:
    return F.filter(pieces(text), lambda w: w != "")


def phrases(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """phrase, n, items: the distinct windows of ``window`` consecutive item
    words (an item of fewer is one window), each with the items that have it."""
    words = items.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"),
                                                              terms(whole_text()).alias("words")).filter(F.size("words") > 0)
    last = F.greatest(F.size("words") - window, F.lit(0))
    starts = words.select("item", "words", F.explode(F.sequence(F.lit(1), last + 1)).alias("at"))
    cut = starts.select("item", F.slice("words", F.col("at"), F.lit(window)).alias("w"))
    return (cut.groupBy(F.array_join("w", " ").alias("phrase"), F.size("w").alias("n"))
            .agg(F.sort_array(F.collect_set("item")).alias("items")))


#: Stands after a text's last piece in its postings; no word holds it.
END = "\0"


def postings(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """term, doc_id, pos of every training word in ``vocabulary`` (term), of
    every empty piece and of the end of every text."""
    marks = docs.sparkSession.createDataFrame([("",), (END,)], "term string")
    words = docs.select("doc_id", F.posexplode(F.concat(pieces(F.col("text")), F.array(F.lit(END)))).alias("pos", "term"))
    return words.join(hinted(vocabulary.unionByName(marks), BROADCAST_ROWS), "term")


def word_counts(index: DataFrame) -> DataFrame:
    """doc_id, n_words: a text's pieces but the empty ones."""
    own = index.filter(F.col("term").isin("", END))
    count = F.max(F.when(F.col("term") == END, F.col("pos"))) - F.count_if(F.col("term") == "")
    return own.groupBy("doc_id").agg(count.cast("long").alias("n_words"))


def rare_terms(wins: DataFrame, docs: DataFrame, rarest: int = RAREST) -> DataFrame:
    """phrase, n, k, term, off: the ``rarest`` terms of each phrase by their
    number of training words, k = 1 the rarest.  Phrases with a term that no
    training text has are gone."""
    parts = wins.select("phrase", "n", F.posexplode(F.split("phrase", " ")).alias("off", "term"))
    vocabulary = hinted(parts.select("term").distinct(), BROADCAST_ROWS)
    words = docs.select(F.explode(pieces(F.col("text"))).alias("term"))
    frequency = table(words.join(vocabulary, "term").groupBy("term").agg(F.count("*").alias("freq")), "frequency")
    known = parts.join(frequency, "term", "left")
    # a term that stands twice in a phrase is asked once
    known = known.groupBy("phrase", "n", "term").agg(F.min("off").alias("off"), F.max("freq").alias("freq"))
    missing = F.max(F.col("freq").isNull()).over(Window.partitionBy("phrase"))
    order = Window.partitionBy("phrase").orderBy("freq", "term")
    return (known.withColumn("missing", missing).filter(~F.col("missing"))
            .withColumn("k", F.row_number().over(order)).filter(F.col("k") <= rarest)
            .select("phrase", "n", "k", "term", "off"))


def candidates(rare: DataFrame, index: DataFrame, rarest: int = RAREST, slop: int = 0) -> DataFrame:
    """phrase, n, doc_id, start: where the rarest terms of a phrase stand at the
    phrase's offsets.  Postings of the rarest term give the starts; each further
    list is adjusted by its offset and intersected.  With ``slop`` the further
    terms may be that many words off (proximity)."""
    index = index.filter(~F.col("term").isin("", END))  # no phrase has these; too many to shuffle by term

    def at(k):
        return hinted(rare.filter(F.col("k") == k).select("phrase", "term", "off"), BROADCAST_ROWS)
    found = (index.join(hinted(rare.filter("k = 1"), BROADCAST_ROWS), "term")
             .select("phrase", "n", "doc_id", (F.col("pos") - F.col("off")).alias("start")).filter(F.col("start") >= -slop))
    for k in range(2, rarest + 1):
        asked = found.join(at(k), "phrase", "left")
        near = asked.withColumn("pos", F.explode(F.sequence(F.col("start") + F.coalesce("off", F.lit(0)) - slop,
                                                            F.col("start") + F.coalesce("off", F.lit(0)) + slop)))
        # phrases of fewer than k different terms have nothing further to ask
        hit = near.filter("term is not null").join(index, ["term", "doc_id", "pos"], "left_semi")
        found = hit.unionByName(near.filter("term is null")).select("phrase", "n", "doc_id", "start")
        found = found.distinct() if slop else found
    return found


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int = 3, window: int = WINDOW,
                      rarest: int = RAREST) -> DataFrame:
    """phrase, doc_id, start: places where all terms of a benchmark window stand
    within ``slop`` words of their offsets.  The rarest terms' postings give the
    places; the others are looked for in the document's own words."""
    rows = one_per_id(docs, "doc_id", ["text"]).withColumn("text", whole_text())
    rare = table(rare_terms(phrases(items, window), rows, rarest), "rare")
    index = table(postings(rows, rare.select("term").distinct()), "postings")
    found = candidates(rare, index, rarest, slop).distinct().withColumn("terms", F.split("phrase", " "))
    by_doc = table(found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "phrase", "terms")).alias("found")), "found")
    ids = hinted(by_doc.select("doc_id"), BROADCAST_ROWS)
    words = rows.join(ids, "doc_id", "left_semi").select("doc_id", pieces(F.col("text")).alias("words")).join(by_doc.hint("merge"), "doc_id")
    first, last = f"greatest(f.start + i - {slop}, 0)", f"f.start + i + {slop}"
    near = F.expr("filter(found, f -> forall(sequence(0, size(f.terms) - 1), i -> "
                  f"array_contains(slice(words, {first} + 1, greatest({last} - {first} + 1, 0)), f.terms[i])))")
    return words.select("doc_id", F.explode(near).alias("f")).select(
        "f.phrase", "doc_id", F.greatest("f.start", F.lit(0)).alias("start")).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, rarest: int = RAREST,
                  share: int = 20) -> DataFrame:
    """Benchmark windows in training documents, per document.

    Training postings of the rarest terms of each window are stored (term,
    doc_id, pos); their offset-adjusted lists are intersected, the rarest first,
    and what is left is compared with the document's own words.

    Returns doc_id, n_words, n_hit (words inside any occurrence of a window),
    items (sorted ids, as text, of items with occurring windows), contaminated
    (n_hit > 0 and ``share`` * n_hit >= n_words), matches (start, n, phrase,
    items; null if no place was compared).
    Null or empty text has no words and is clean; items without words match
    nothing; items with equal windows are all reported.  Rows without an id are
    left out, documents that repeat one count once; without items every document
    is clean; without documents there are no rows.
    """
    rows = one_per_id(docs, "doc_id", ["text"]).withColumn("text", whole_text())
    wins = table(phrases(items, window), "phrases")
    rare = table(rare_terms(wins, rows, rarest), "rare")
    index = table(postings(rows, rare.select("term").distinct()), "postings")
    found = candidates(rare, index, rarest).join(hinted(wins.select("phrase", "items"), BROADCAST_ROWS), "phrase")
    by_doc = table(found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "phrase", "items")).alias("found")), "found")
    ids = hinted(by_doc.select("doc_id"), BROADCAST_ROWS)
    words = rows.join(ids, "doc_id", "left_semi").select("doc_id", pieces(F.col("text")).alias("words")).join(by_doc.hint("merge"), "doc_id")
    there = F.expr("filter(found, f -> f.start + f.n <= size(words) "
                   "and array_join(slice(words, f.start + 1, f.n), ' ') = f.phrase)")
    own = words.select("doc_id", there.alias("matches")).select(
        "doc_id", "matches",
        F.expr("cast(size(array_distinct(flatten(transform(matches, m -> sequence(m.start, m.start + m.n - 1))))) as long)").alias("n_hit"),
        F.expr("array_sort(array_distinct(flatten(transform(matches, m -> m.items))))").alias("items"))
    out = word_counts(index).join(own, "doc_id", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"), "matches")
