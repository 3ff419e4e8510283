"""Stores that grow: stream state, append ledger, prompt cache, heavy words, ranged ids."""

import os

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import codes as C
from tallyspark.operators import vehicle as V
from tallyspark.operators.heavy import sketch, top_words
from tallyspark.operators.promptcache import PromptCache, prompt_key
from tallyspark.operators.text import build_vocab, words
from tallyspark.session import scratch_path
from tallyspark.sources import io as IO
from tallyspark.streaming.scoring import CaseStore, latest_scores, run_to_completion, score_batch

VEH = "caseid long, vehno int, crashcat int, crashconf string, crashtype int"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def paths(spark, *names):
    return [scratch_path(spark, n) for n in names]


def scores(df):
    return sorted((r["caseid"], r["n_pred"], r["recall"], r["exact_acc"]) for r in df.collect())


# --- X1 --------------------------------------------------------------------------------


def test_a_case_over_two_batches_is_scored_whole(spark):
    truth = spark.createDataFrame([(1, 1, 1, "A", 1), (1, 2, 2, "B", 9), (9000, 1, 3, "C", 21), (5, 1, 1, "A", 1)], VEH)
    pred = [(1, 1, 1, "A", 1), (9000, 1, 3, "C", 21), (None, 1, 1, "A", 1), (1, 2, 2, "B", 9), (77, 1, 1, "A", 1)]
    root, pred_dir, state, out, ckpt = paths(spark, "x-truth", "x-in", "x-state", "x-out", "x-ckpt")
    store = CaseStore(root, buckets=8, span=10).write(truth)
    first, second = (spark.createDataFrame(p, VEH) for p in (pred[:3], pred[3:]))
    first.write.mode("append").parquet(pred_dir)
    run_to_completion(spark, pred_dir, store, state, out, ckpt)
    assert scores(latest_scores(spark, out)) == [(1, 1, 0.5, 1.0), (9000, 1, 1.0, 1.0)]
    second.write.mode("append").parquet(pred_dir)
    whole = scores(run_to_completion(spark, pred_dir, store, state, out, ckpt))
    assert whole == [(1, 2, 1.0, 1.0), (77, 1, 0.0, 0.0), (9000, 1, 1.0, 1.0)]
    touched = truth.where("caseid in (1, 9000)").unionByName(truth.limit(0))
    assert whole == scores(V.vehicle_eval(touched, first.unionByName(second).where("caseid is not null")))
    for again in ((first, 0), (second, 1), (second, 1), (first, 0)):  # replays, in any order
        score_batch(*again, store, state, out)
        assert scores(latest_scores(spark, out)) == whole
    assert latest_scores(spark, out).where("caseid = 1").count() == 1


def test_a_batch_without_cases_writes_nothing(spark):
    root, state, out = paths(spark, "x-truth", "x-state", "x-out")
    store = CaseStore(root).write(spark.createDataFrame([(1, 1, 1, "A", 1)], VEH))
    score_batch(spark.createDataFrame([(None, 1, 1, "A", 1)], VEH), 0, store, state, out)
    assert not os.path.exists(out)


def test_truth_is_read_by_touched_bucket(spark):
    root = scratch_path(spark, "x-truth")
    truth = spark.range(1000).select(F.col("id").alias("caseid"), F.lit(1).alias("vehno"), F.lit(1).alias("crashcat"),
                                     F.lit("A").alias("crashconf"), F.lit(1).alias("crashtype"))
    store = CaseStore(root, buckets=16, span=10).write(truth)
    part = store.read(spark, [3], 30, 35)
    p = plan(part)
    assert "PartitionFilters: [" in p and "bucket" in p.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(caseid,30)" in p
    assert sorted(r["caseid"] for r in part.collect()) == list(range(30, 36))
    read = part.select(F.input_file_name().alias("f")).distinct().collect()
    assert read and all("bucket=3/" in r["f"] for r in read)


# --- S8 --------------------------------------------------------------------------------


def test_replays_of_an_append_count_once(spark):
    path = scratch_path(spark, "ledger")
    a = spark.createDataFrame([(1, 0.5), (2, None), (2, None)], "caseid long, f1 double")
    b = spark.createDataFrame([(3, 0.25)], "caseid long, f1 double")
    first = IO.append_once(a, path)
    assert IO.append_once(a.orderBy(F.col("caseid").desc()).repartition(3), path) == first
    IO.append_once(b, path)
    IO.append_once(b, path, batch_id="b-again")
    IO.append_once(a, path, batch_id="b-again")  # that id is taken: a replay
    got = IO.read_appended(spark, path)
    assert sorted((r["caseid"], r["f1"]) for r in got.where("caseid <> 2").collect()) == [(1, 0.5), (3, 0.25), (3, 0.25)]
    assert got.where("caseid = 2").count() == 2 and got.select("batch").distinct().count() == 3
    with pytest.raises(ValueError):
        IO.append_once(a, path, batch_id="../x")


def test_half_written_batches_do_not_count(spark):
    path = scratch_path(spark, "ledger")
    with pytest.raises(FileNotFoundError):
        IO.read_appended(spark, path)
    a = spark.createDataFrame([(1,)], "caseid long")
    a.write.parquet(f"{path}/batch=half")
    os.remove(f"{path}/batch=half/_SUCCESS")  # as a writer leaves it that died before its commit
    IO.append_once(spark.createDataFrame([(2,)], "caseid long"), path, batch_id="whole")
    assert [r["caseid"] for r in IO.read_appended(spark, path).collect()] == [2]
    IO.append_once(a, path, batch_id="half")
    assert sorted(r["caseid"] for r in IO.read_appended(spark, path).collect()) == [1, 2]


# --- T6 --------------------------------------------------------------------------------


def test_cache_is_joined_where_it_lies(spark):
    folder = scratch_path(spark, "cache")
    cache = PromptCache("cache_" + folder.rsplit("-", 1)[-1], folder, 16).open(spark)
    asked = spark.createDataFrame([("p1",), ("p2",), ("p2",), (None,), ("p3",)], "prompt string")
    assert {r["prompt"]: (r["answer"], r["cached"]) for r in cache.lookup(asked).collect()} == {
        p: (None, False) for p in ("p1", "p2", "p3")}
    key = asked.where("prompt is not null").distinct().select(prompt_key(), F.upper("prompt").alias("answer"))
    some = key.where("answer <> 'P3'")
    cache.add(some)
    cache.add(some)  # a replay
    cache.add(some.withColumn("answer", F.lit("Z")))
    got = cache.lookup(asked)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shape = plan(cache.lookup(asked))
        cached_side = plan(cache.known(spark))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in cached_side and shape.count("Exchange") == 2 and "Bucketed: true" in shape
    assert {r["prompt"]: (r["answer"], r["cached"]) for r in got.collect()} == {
        "p1": ("P1", True), "p2": ("P2", True), "p3": (None, False)}
    again = PromptCache(cache.name + "_2", folder, 16).open(spark)  # another session finds the files
    assert again.lookup(asked).where("cached").count() == 2


# --- T12 -------------------------------------------------------------------------------


@pytest.mark.parametrize("k,buckets,sample", [(5, 4, 0.5), (50, 64, 0.2), (50, 1 << 16, 0.01), (10_000, 128, 0.3), (40, 16, 0.0)])
def test_top_words_equal_a_full_count(spark, k, buckets, sample):
    # Zipf-like counts with long ties at every cut
    df = spark.range(400).select(F.concat_ws(" ", F.transform(
        F.sequence(F.lit(1), F.lit(30)), lambda i: F.concat(F.lit("W"), F.pmod(F.floor(300 / (1 + F.pmod(F.col("id") * 7 + i * i, F.lit(60)))), F.lit(97)).cast("string")))).alias("text"))
    df = df.unionByName(spark.range(300).select(F.concat(F.lit("rare"), F.col("id").cast("string"), F.lit(" x")).alias("text")))
    df = df.unionByName(spark.createDataFrame([(None,), ("",), (" \t ",)], "text string")).repartition(4)
    want = [tuple(r) for r in build_vocab(df, "text", k).orderBy("id").collect()]
    got = [tuple(r) for r in top_words(df, "text", k, buckets=buckets, sample=sample).orderBy("id").collect()]
    assert got == want


def test_top_words_of_nothing(spark):
    assert top_words(spark.createDataFrame([], "text string"), k=3).count() == 0


def test_the_sketch_holds_no_more_than_its_counters(spark):
    df = spark.range(3000).select(F.concat(F.lit("a b c d rare"), F.col("id").cast("string")).alias("text"))
    tokens = df.select(F.explode(words(F.col("text"))).alias("word"))
    guesses = spark.createDataFrame([(w,) for w in "abcd"], "word string")
    held = sketch(tokens, guesses, 64)
    assert {r["word"]: r["n"] for r in held.where("word is not null").collect()} == dict.fromkeys("abcd", 3000)
    others = held.where("word is null")
    assert others.count() <= 64 and others.agg(F.sum("n")).first()[0] == 3000
    assert others.where("n >= 3000").count() == 0  # so no word is counted in the second pass
    top = top_words(df, "text", 4, buckets=64, sample=0.2).orderBy("id").collect()
    assert [(r["word"], r["id"], r["n"]) for r in top] == [(w, i + 2, 3000) for i, w in enumerate("abcd")]


# --- C2 --------------------------------------------------------------------------------


def test_ranged_ids_equal_the_window(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.md5((F.col("id") % 1700).cast("string"))).alias("x"))
    df = df.unionByName(spark.createDataFrame([(None,), ("",), ("é",), ("Z",)], "x string"))
    want = {r["label"]: r["label_id"] for r in C.label_mapping(df, "x").collect()}
    ranged = C.label_mapping_ranged(df, "x", 7)
    assert {r["label"]: r["label_id"] for r in ranged.collect()} == want
    windows = [line for line in plan(ranged).splitlines() if "Window [" in line]
    assert windows and all("[part#" in line for line in windows)
    assert C.label_mapping_ranged(df.limit(0), "x").count() == 0
