"""A5–A7 as a stored state: vote counts per sample, to which runs are added."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators.agree import consistency_from_counts


@dataclass(frozen=True)
class VoteState:
    """Counts of votes per (sample, label) of all runs so far, at ``path`` (shared storage).

    Adding a run reads that run and the counts, never an earlier run's votes, and
    writes a new version: counts beside the ids of the runs in them.  A version is there
    once its counts are committed, so a run counts once however often it is added,
    and one that failed half-way is written anew.  One writer at a time.
    A sample without a vote is kept, with a count of 0 for the label null.
    """

    path: str
    sample: tuple[str, ...]
    label: str
    truth: str | None = None
    by: tuple[str, ...] = ()

    @property
    def keys(self) -> list[str]:
        return [*self.by, *self.sample, *([self.truth] if self.truth else [])]

    def _files(self, spark: SparkSession):
        fs = spark._jvm.org.apache.hadoop.fs
        return fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration()), fs.Path

    def versions(self, spark: SparkSession) -> list[int]:
        """Committed versions, oldest first."""
        fs, path = self._files(spark)
        marks = fs.globStatus(path(f"{self.path}/version=*/counts/_SUCCESS"))
        return sorted(int(m.getPath().getParent().getParent().getName().split("=")[1]) for m in marks or [])

    def _read(self, spark: SparkSession, version: int, part: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/version={version}/{part}")

    def runs(self, spark: SparkSession) -> DataFrame:
        """run: ids of the runs that are in the counts."""
        have = self.versions(spark)
        return self._read(spark, have[-1], "runs") if have else spark.createDataFrame([], "run string")

    def add(self, votes: DataFrame, run_id: str) -> bool:
        """Add a run's votes (key columns and label; null is no vote).  Returns
        whether it was new."""
        spark = votes.sparkSession
        have = self.versions(spark)
        runs = self.runs(spark)
        if not runs.where(F.col("run") == run_id).isEmpty():
            return False
        cols = [*self.keys, self.label]
        new = votes.groupBy(*cols).agg(F.count(self.label).alias("n"))
        if have:
            old = self._read(spark, have[-1], "counts").select(*cols, "n")
            new = old.unionByName(new).groupBy(*cols).agg(F.sum("n").alias("n"))
        at = f"{self.path}/version={have[-1] + 1 if have else 1}"
        runs.unionByName(spark.createDataFrame([(run_id,)], "run string")).coalesce(1).write.mode("overwrite").parquet(f"{at}/runs")
        new.write.mode("overwrite").parquet(f"{at}/counts")
        return True

    def counts(self, spark: SparkSession) -> DataFrame:
        """Key columns, label, n of the latest version; raises if no run was added."""
        have = self.versions(spark)
        if not have:
            raise FileNotFoundError(f"no run has been added to {self.path}")
        return self._read(spark, have[-1], "counts")

    def consistency(self, spark: SparkSession, rounded: bool = True) -> DataFrame:
        """What ``sample_consistency`` says of the votes of all runs at once."""
        return consistency_from_counts(self.counts(spark), list(self.sample), self.label, self.truth, list(self.by), "n", rounded)

    def prune(self, spark: SparkSession, keep: int = 2) -> None:
        """Remove all but the last ``keep`` (at least one) versions; readers of those are done."""
        fs, path = self._files(spark)
        for v in self.versions(spark)[:-max(1, keep)]:
            fs.delete(path(f"{self.path}/version={v}"), True)
