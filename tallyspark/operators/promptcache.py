"""T6 as a stored table: answers by prompt key, bucketed, joined where they lie."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def prompt_key(prompt: str = "prompt"):
    return F.md5(F.col(prompt)).alias("prompt_key")


@dataclass(frozen=True)
class PromptCache:
    """Answers known so far, in a Parquet table bucketed and sorted by prompt key.

    A lookup shuffles the distinct new prompts only, to the table's buckets; the cache is
    read bucket by bucket where it lies.  So that Spark keeps to the buckets there must be
    at least as many as shuffle partitions.  ``name`` is the table's in the catalog of
    this session; the files at ``path`` (shared storage) outlive it.
    """

    name: str
    path: str
    buckets: int = 64

    def open(self, spark: SparkSession) -> PromptCache:
        """Register the table, new or with the files that are there."""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (prompt_key STRING, answer STRING) USING parquet "
                  f"CLUSTERED BY (prompt_key) SORTED BY (prompt_key) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        return self

    def add(self, answers: DataFrame) -> None:
        """Append answers (prompt_key, answer): one file per bucket and call.  Adding
        the same ones again changes no lookup."""
        new = answers.select("prompt_key", F.col("answer").cast("string").alias("answer"))
        new.repartition(self.buckets, "prompt_key").write.insertInto(self.name)
        new.sparkSession.catalog.refreshTable(self.name)

    def known(self, spark: SparkSession) -> DataFrame:
        """One answer per key: the smallest, whichever call added it; grouped within buckets."""
        return (spark.table(self.name).groupBy("prompt_key")
                .agg(F.min("answer").alias("answer"), F.lit(True).alias("cached")))

    def lookup(self, prompts: DataFrame, prompt: str = "prompt") -> DataFrame:
        """prompt_key, prompt, answer, cached: each distinct prompt once, with the
        stored answer or as a miss (null prompts have no key and are left out)."""
        keyed = prompts.where(F.col(prompt).isNotNull()).select(prompt_key(prompt), F.col(prompt).alias("prompt"))
        # repeats go before anything moves to the buckets, however often one prompt is asked
        new = keyed.groupBy("prompt_key").agg(F.min("prompt").alias("prompt")).repartition(self.buckets, "prompt_key")
        return (new.join(self.known(prompts.sparkSession), "prompt_key", "left")
                .withColumn("cached", F.coalesce("cached", F.lit(False))))
