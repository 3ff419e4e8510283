"""Incremental vehicle scoring with Structured Streaming.

Prediction files arrive in a folder.  A case's predictions may come over several
files and micro-batches: every batch first adds its rows to a state table, and then
scores the cases it touches from all that has come for them so far.

Truth and state are stored by bucket, a run of neighbouring case ids, so a batch
reads only the buckets it touches, and within them the row groups
between its least and greatest case.  Nothing is read whole per batch.

Replays: a batch's rows and its scores each live in folders of its id that are
overwritten, and a batch is scored from the rows of batches up to its own, so running one
again, at once or later, changes nothing.  A case scored by several batches has a row per
batch; ``latest_scores`` keeps the last.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.operators.vehicle import vehicle_eval

PRED_SCHEMA = T.StructType([
    T.StructField("caseid", T.LongType()), T.StructField("vehno", T.IntegerType()),
    T.StructField("crashcat", T.IntegerType()), T.StructField("crashconf", T.StringType()),
    T.StructField("crashtype", T.IntegerType())])


@dataclass(frozen=True)
class CaseStore:
    """Where truth is kept by bucket: case ids in runs of ``span``, dealt round
    ``buckets`` folders."""

    path: str
    buckets: int = 256
    span: int = 4096

    def bucket(self, case: str = "caseid") -> Column:
        return F.pmod(F.floor(F.col(case) / self.span), F.lit(self.buckets)).cast("int").alias("bucket")

    def write(self, truth: DataFrame) -> CaseStore:
        """Write the truth table once; sorted by case, so that row groups can be skipped."""
        (truth.where("caseid is not null").select("*", self.bucket())
         .repartitionByRange("bucket", "caseid").sortWithinPartitions("bucket", "caseid")
         .write.mode("overwrite").partitionBy("bucket").parquet(self.path))
        return self

    def read(self, spark: SparkSession, touched: list[int], least: int, greatest: int) -> DataFrame:
        """Truth rows of the touched buckets and range of cases."""
        return (spark.read.parquet(self.path)
                .where(F.col("bucket").isin(touched) & F.col("caseid").between(least, greatest)).drop("bucket"))


def score_batch(batch: DataFrame, batch_id: int, store: CaseStore, state: str, out: str, mode: str = "type") -> None:
    """Add one batch to the state and write the scores of its cases to
    ``<out>/batch_id=<id>``; rows without a case are left out."""
    spark = batch.sparkSession
    rows = batch.where("caseid is not null").select("*", store.bucket())
    about = rows.groupBy("bucket").agg(F.min("caseid").alias("a"), F.max("caseid").alias("b")).collect()  # a row per bucket
    if not about:
        return
    touched = sorted(r["bucket"] for r in about)
    least, greatest = min(r["a"] for r in about), max(r["b"] for r in about)
    (rows.withColumn("batch_id", F.lit(batch_id).cast("long")).repartitionByRange("bucket", "caseid")
     .sortWithinPartitions("bucket", "caseid").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("bucket", "batch_id").parquet(state))
    kept = T.StructType([*batch.schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("batch_id", T.LongType())])
    seen = (spark.read.schema(kept).option("basePath", state).parquet(*[f"{state}/bucket={b}" for b in touched])
            .where(F.col("batch_id") <= batch_id).where(F.col("caseid").between(least, greatest)))
    cases = seen.where(F.col("batch_id") == batch_id).select("caseid").distinct()
    pred = seen.drop("bucket", "batch_id").join(cases, "caseid", "left_semi")
    truth = store.read(spark, touched, least, greatest).join(cases, "caseid", "left_semi")
    vehicle_eval(truth, pred, mode).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")


def score_stream(spark: SparkSession, pred_dir: str, store: CaseStore, state: str, out: str, checkpoint: str,
                 mode: str = "type", schema: T.StructType = PRED_SCHEMA, batch_bytes: int = 1 << 30):
    """Start the stream over every file present now (``availableNow``), in
    micro-batches of about ``batch_bytes`` of files, and return the query handle."""
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(pred_dir)
    return (stream.writeStream.foreachBatch(lambda batch, i: score_batch(batch, i, store, state, out, mode))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def latest_scores(spark: SparkSession, out: str) -> DataFrame:
    """One row per case: its scores by the last batch that touched it, and that batch's id."""
    rows = spark.read.parquet(out)
    last = F.max(F.struct("batch_id", *[c for c in rows.columns if c not in ("batch_id", "caseid")])).alias("last")
    return rows.groupBy("caseid").agg(last).select("caseid", "last.*")


def run_to_completion(spark: SparkSession, pred_dir: str, store: CaseStore, state: str, out: str, checkpoint: str,
                      mode: str = "type", batch_bytes: int = 1 << 30) -> DataFrame:
    """Run the stream until every file present is scored, however long that takes."""
    q = score_stream(spark, pred_dir, store, state, out, checkpoint, mode, batch_bytes=batch_bytes)
    q.awaitTermination()
    return latest_scores(spark, out)
