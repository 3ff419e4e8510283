"""The k most frequent words without shuffling every distinct word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.joins import checked_broadcast
from tallyspark.operators.text import words
from tallyspark.session import scratch_path

#: Counters of the sketch, and the part of the rows that guesses are drawn from.
BUCKETS = 1 << 20
SAMPLE = 0.05


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("word"), F.lit(buckets))


def sketch(tokens: DataFrame, guesses: DataFrame, buckets: int) -> DataFrame:
    """word, bucket, n: exact counts of the guessed words, and of all others
    only a count per hash bucket.  Mergeable: counts of two tables add up."""
    flagged = tokens.join(checked_broadcast(guesses.select("word", F.lit(True).alias("known"))), "word", "left")
    key = flagged.select(F.when(F.col("known"), F.col("word")).alias("word"),
                         F.when(F.col("known").isNull(), _bucket(buckets)).alias("bucket"))
    return key.groupBy("word", "bucket").agg(F.count(F.lit(1)).alias("n"))


def top_words(df: DataFrame, text_col: str = "text", k: int = 20000, first_id: int = 2, buckets: int = BUCKETS,
              sample: float = SAMPLE, seed: int = 12) -> DataFrame:
    """The same result as ``build_vocab``; of the distinct words only those that
    can be among the k most frequent are shuffled.

    1. The 2k most frequent words of a sample of rows are guesses.
    2. One pass counts the guesses exactly and every other word into one of
       ``buckets`` counters.  Let t be the k-th greatest count of a guess (1 if there are
       fewer): k words occur t times or more, so no word that occurs less often is
       among the first k, whatever the tie rule.  A word in a bucket of count n
       occurs at most n times, so words of buckets below t are out.
    3. A second pass counts the words of the other buckets exactly.

    Words of count t or more are so all counted exactly, ties at t too; a bad
    sample costs time, never a word.  Shuffled are at most 2k words and ``buckets``
    numbers per task, and the words of the buckets left.
    """
    tokens = df.select(F.explode(words(F.col(text_col))).alias("word"))
    drawn = df.sample(sample, seed).select(F.explode(words(F.col(text_col))).alias("word"))
    guesses = drawn.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "word").limit(2 * k)
    guesses = _stored(guesses.select("word"), "vocab-guesses")
    held = _stored(sketch(tokens, guesses, buckets), "vocab-sketch")
    exact = held.where("word is not null").select("word", "n")
    best = exact.orderBy(F.col("n").desc()).limit(k).agg(F.count("n").alias("held"), F.min("n").alias("least")).first()
    least = best["least"] if best["held"] == k else 1
    left = held.where(F.col("bucket").isNotNull() & (F.col("n") >= least)).select("bucket")
    others = (tokens.withColumn("bucket", _bucket(buckets)).join(checked_broadcast(left), "bucket", "left_semi")
              .join(checked_broadcast(guesses), "word", "left_anti")
              .groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    top = (exact.unionByName(others).where(F.col("n") >= least)
           .orderBy(F.col("n").desc(), F.col("word")).limit(k))
    return top.select("word", (F.row_number().over(Window.orderBy(F.col("n").desc(), F.col("word"))) + first_id - 1).alias("id"), "n")
