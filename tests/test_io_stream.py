import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.session import scratch_path
from tallyspark.sources import io as IO

ADAPT = T.StructType([T.StructField("CASEID", T.LongType()), T.StructField("VEHNO", T.IntegerType()),
                      T.StructField("ADAPT", T.IntegerType()), T.StructField("CASEWGT", T.DoubleType())])


def test_read_yearly_csv_crlf_and_extension_case(spark):
    root = tempfile.mkdtemp(prefix="yearly-", dir="/tmp")
    files = {2018: "ADAPT.CSV", 2021: "ADAPT.csv"}
    for y, name in files.items():
        d = os.path.join(root, f"SURVEY_{y}_CSV_files")
        os.makedirs(d)
        with open(os.path.join(d, name), "w", newline="") as f:
            f.write("CASEID,VEHNO,ADAPT,CASEWGT\r\n")
            f.write(f"{y}01,1,0,12.5\r\n{y}02,2,1,3.25\r\n")
        with open(os.path.join(d, "DISTRACT.csv"), "w") as f:
            f.write("CASEID,VEHNO,DISTRACTN\n1,1,2\n")
    got = sorted(tuple(r) for r in IO.read_yearly_csv(spark, root, "ADAPT", ADAPT).collect())
    assert got == [(2018, 201801, 1, 0, 12.5), (2018, 201802, 2, 1, 3.25),
                   (2021, 202101, 1, 0, 12.5), (2021, 202102, 2, 1, 3.25)]


def test_read_prediction_runs_aliases(spark):
    root = scratch_path(spark, "runs-test")
    spark.createDataFrame([("a", "1", "1"), ("METRICS (ALL)", "accuracy", "0.91")], "SUMMARY string, MANCOLL string, collision_type string") \
        .write.parquet(f"{root}/bert_test_results_x-1")
    spark.createDataFrame([("a", "1", "2")], "summary string, labels string, output string") \
        .write.parquet(f"{root}/bert_test_results_x-2")
    df = IO.read_prediction_runs(spark, [f"{root}/bert_test_results_x-1", f"{root}/bert_test_results_x-2"])
    df = IO.with_run_tag(df.withColumn("file", F.regexp_extract("file", r"([^/]+)/[^/]+$", 1)))
    got = sorted((r["summary"], r["gt"], r["pred"], r["model_key"], r["run_id"]) for r in df.collect())
    assert got == [("a", "1", "1", "x", 1), ("a", "1", "2", "x", 2)]


def test_read_cases_missing_column_raises(spark):
    root = scratch_path(spark, "cases-test")
    spark.createDataFrame([(1, "t")], "CASEID long, SUMMARY string").write.parquet(root)
    with pytest.raises(ValueError):
        IO.read_cases(spark, root, {"caseid": "CASEID", "mancoll": "MANCOLL"})


def test_profile_tables(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "x int, y string")
    got = {r["column_name"]: (r["n_rows"], r["n_null"], r["n_distinct"])
           for r in IO.profile_tables({"t": df}).collect()}
    assert got == {"x": (3, 0, 2), "y": (3, 1, 2)}


def test_head_n_per_group(spark):
    df = spark.createDataFrame([(g, i) for g in ("a", "b") for i in range(10)], "g string, i int")
    got = sorted(tuple(r) for r in IO.head_n(df, ["i"], 3, by=["g"]).collect())
    assert got == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1), ("b", 2)]


def test_hot_class_exact_split(spark):
    # one class holds a third of all rows; quotas stay exact
    df = spark.range(3000).select(F.col("id").alias("k"),
                                  F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50 + 1).alias("c"))
    from tallyspark.operators.sample import stratified_split
    s = stratified_split(df, ["k"], "c", 10, 7)
    per = {r["c"]: r["count"] for r in s.where("split = 'test'").groupBy("c").count().collect()}
    assert per[0] == 100 and sum(per.values()) == 300


def test_null_class_kept_in_stratified_split(spark):
    from tallyspark.operators.sample import stratified_split
    df = spark.range(200).select(F.col("id").alias("k"),
                                 F.when(F.col("id") % 4 == 0, F.lit(None)).otherwise(F.col("id") % 2).alias("c"))
    s = stratified_split(df, ["k"], "c", 25, 3)
    assert s.count() == 200
    test = {r["c"]: r["count"] for r in s.where("split = 'test'").groupBy("c").count().collect()}
    # T = 50; shares 12.5 / 12.5 / 25; the one leftover seat goes to class 0 (nulls sort last)
    assert test == {None: 12, 0: 13, 1: 25}
