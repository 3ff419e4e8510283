"""Registered batch prediction (T5), Spark ML baselines (B1–B3) and the
incremental scoring stream (X1)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions.codes import NOISE_LEVELS
from tallyspark.functions.hashing import hash32, sql_hash32
from tallyspark.operators import baseline as B
from tallyspark.operators.predict import centroid_predictor, predict_table
from tallyspark.operators.sample import random_split
from tallyspark.plans.queries_vehicle import _eval_sql, _F, _F2, _K
from tallyspark.plans.registry import register
from tallyspark.session import scratch_path
from tallyspark.sources.fixtures import Views, with_views
from tallyspark.streaming.scoring import CaseStore, latest_scores, run_to_completion, score_batch


def emb_split(spark, sf_dir):
    """Embeddings for fitting (four fifths, by hash) and the others."""
    e = Views(spark, sf_dir).emb
    held = hash32("vec_id", "t5") % 5 == 0
    return e.where(~held), e.where(held)


_EMB_HELD = f"{sql_hash32('vec_id', repr('t5'))} % 5 = 0"


@register("predict_table", sql=(
    "WITH tr AS (SELECT label, unnest(range(len(embedding))) AS pos, unnest(embedding) AS x FROM embeddings "
    f"WHERE NOT ({_EMB_HELD})), c AS (SELECT label, pos, avg(x) AS m FROM tr GROUP BY ALL), "
    "te AS (SELECT vec_id, label AS own, unnest(range(len(embedding))) AS pos, unnest(embedding) AS x FROM embeddings "
    f"WHERE {_EMB_HELD}), d AS (SELECT te.vec_id, te.own, c.label, sum((te.x - c.m) * (te.x - c.m)) AS dist "
    "FROM te JOIN c USING (pos) GROUP BY ALL) "
    "SELECT vec_id, own AS label, CAST(arg_min(label, dist) AS INTEGER) AS pred FROM d GROUP BY ALL"),
    note="nearest-centroid predictor, fitted on the training rows, applied to the others")
def q_predict_table(spark, sf_dir):
    train, test = emb_split(spark, sf_dir)
    make = centroid_predictor(train, "embedding", "label")
    return predict_table(test, make, "pred", T.IntegerType(), ["embedding"]).select("vec_id", "label", "pred")


@register("embedding_lr", note="rows only: Spark ML logistic regression; sizes in embedding_lr_sizes")
def q_embedding_lr(spark, sf_dir):
    return B.embedding_lr(Views(spark, sf_dir).emb)


@register("embedding_lr_report", note="rows only: per-class report of the B1 model")
def q_embedding_lr_report(spark, sf_dir):
    return B.embedding_lr_report(Views(spark, sf_dir).emb)


@register("embedding_lr_sizes", sql=(
    "WITH c AS (SELECT label, count(*) AS nc, sum(count(*)) OVER () AS n FROM embeddings GROUP BY label), "
    "q AS (SELECT *, (nc * ((20 * n + 99) // 100)) // n AS base, (nc * ((20 * n + 99) // 100)) % n AS rem, "
    "(20 * n + 99) // 100 AS t FROM c) SELECT label, nc AS n, CAST(base + CASE WHEN row_number() OVER "
    "(ORDER BY rem DESC, label) <= t - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS n_test FROM q"),
    note="B1: rows and predicted test rows per class")
def q_embedding_lr_sizes(spark, sf_dir):
    e = Views(spark, sf_dir).emb
    tests = B.embedding_predictions(e).groupBy("label").agg(F.count("pred").alias("n_test"))
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(tests, "label")


def bow_split(spark, sf_dir):
    s = random_split(Views(spark, sf_dir).docs, ["doc_id"], 20, 0, 42)
    return s.where(F.col("split") == "train").drop("split"), s.where(F.col("split") == "test").drop("split")


@register("bow_linear", note="rows only: Spark ML bag-of-words logistic regression; score in bow_linear_score")
def q_bow_linear(spark, sf_dir):
    train, test = bow_split(spark, sf_dir)
    return B.bow_linear(train, test, weighted=True).select("doc_id", "lang", "pred_lang")


@register("bow_linear_score", sql=(
    f"SELECT lang, count(*) AS n, true AS beats_majority FROM (SELECT lang, row_number() OVER (ORDER BY "
    f"{sql_hash32('doc_id', repr('seed42'))}, doc_id) AS rn, count(*) OVER () AS total FROM documents) "
    "WHERE rn <= (20 * total + 99) // 100 GROUP BY lang"),
    note="B2: test rows per language, and that the model beats the largest one")
def q_bow_linear_score(spark, sf_dir):
    train, test = bow_split(spark, sf_dir)
    per = B.bow_linear(train, test, weighted=True).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("lang") == F.col("pred_lang")).alias("hit"))
    whole = Window.partitionBy(F.lit(0))  # a row per language
    return per.select("lang", "n", (F.sum("hit").over(whole) > F.max("n").over(whole)).alias("beats_majority"))


@register("noise_robustness", note="rows only: one bag-of-words model per noise level; ladder in noise_training_sizes")
def q_noise_robustness(spark, sf_dir):
    return B.noise_robustness(Views(spark, sf_dir).docs)


@register("noise_training_sizes", sql=(
    "WITH t AS (SELECT count(*) - (20 * count(*) + 99) // 100 AS n FROM documents) "
    "SELECT CAST(p AS INTEGER) AS noise_pct, n AS n_train, CAST(p * n // 100 AS BIGINT) AS n_changed, "
    "CAST(0 AS BIGINT) AS n_kept_label FROM t, (VALUES " + ", ".join(f"({x})" for x in NOISE_LEVELS) + ") l(p)"),
    note="B3: training rows, rows with another label, and rows that count as changed with the same label")
def q_noise_training_sizes(spark, sf_dir):
    d = Views(spark, sf_dir).docs
    ladder = B.noisy_training(d, "doc_id", "lang", NOISE_LEVELS, 42, 20)[2]
    same = F.col("lang").eqNullSafe(F.col("_noisy"))
    return ladder.groupBy("noise_pct").agg(F.count(F.lit(1)).alias("n_train"), F.count_if(~same).alias("n_changed"),
                                           F.count_if(same & F.col("changed")).alias("n_kept_label"))


@register("incremental_scoring", sql=with_views(["gv", "vp1"],
    "SELECT * FROM ev WHERE caseid IN (SELECT caseid FROM vp1)",
    [_K, _F, _F2, ("ev", _eval_sql("exact_ok"))]),
    note="predictions of a case arrive over three batches, one of them twice; oracle = V3 over the cases with predictions")
def q_incremental_scoring(spark, sf_dir):
    v = Views(spark, sf_dir).kept_vehicles()
    # The static side is written once, by bucket; a batch reads the buckets it touches.
    store = CaseStore(scratch_path(spark, "stream-truth")).write(v.gv)
    pred_dir, state, out, ckpt = (scratch_path(spark, f"stream-{x}") for x in ("in", "state", "out", "ckpt"))
    arrivals = v.vpred.withColumn("arrival", F.pmod("vehno", F.lit(3)))
    path = scratch_path(spark, "arrivals")
    arrivals.write.partitionBy("arrival").parquet(path)
    arrived = spark.read.parquet(path)
    parts = [arrived.where(F.col("arrival") == i).drop("arrival") for i in range(3)]
    for part in parts:  # a case's vehicles come in different files, at different times
        part.write.mode("append").parquet(pred_dir)
        run_to_completion(spark, pred_dir, store, state, out, ckpt)
    score_batch(parts[0], 0, store, state, out)  # the first batch again, after the others
    return latest_scores(spark, out).drop("batch_id")
