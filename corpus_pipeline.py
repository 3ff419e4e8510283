"""From raw documents to token files, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import decontam, minhash, mixing, tokens, toxicity
from tallyspark.llm.common import one_per_id, read, scratch_path, without
from tallyspark.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model does not reject."""
    model = toxicity.fit(toxicity.binary_grades(docs, read(spark, sf_dir, "labels")))
    judge = toxicity.severity_column(model)
    return docs.withColumn("_judged", judge(F.col("text"))).filter("not _judged.toxic").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of similar ones (five-word
    shingles, 0.8)."""
    rows = one_per_id(docs, "doc_id", [c for c in docs.columns if c != "doc_id"], nameless=True)
    gone = minhash.near_duplicates(docs).filter("not kept")
    return without(rows, gone).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark text to speak of."""
    gone = decontam.decontaminate(docs, read(spark, sf_dir, "benchmark")).filter("contaminated")
    return without(docs, gone).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, one row per document."""
    return mixing.take(docs, mixing.mix_sources(docs))


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, and their index: doc_id, start, n_tokens,
    ids_crc32."""
    path = scratch_path(spark, "pipeline-tokens")
    tokens.write_tokens(docs, path, tokenizer_path())
    return tokens.token_digest(spark, path)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix", mix),
    ("tokens", write_token_files),
]

#: Not expressible in SQL: a fitted model and a tokenizer; tested stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each result written and read again."""
    def step(docs: DataFrame, stage) -> DataFrame:
        name, function = stage
        path = scratch_path(spark, f"stage-{name}")
        function(spark, docs, sf_dir).write.parquet(path)
        return spark.read.parquet(path)
    return reduce(step, STAGES, read(spark, sf_dir, "documents"))
