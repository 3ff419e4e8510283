"""What the review of round 3 found."""

import threading
import time

from pyspark.sql import functions as F

from tallyspark.operators import baseline as B
from tallyspark.operators.relate import first_per_key
from tallyspark.sources import io as IO
from tallyspark.sources.fixtures import Views


def test_path_parts_take_linear_time(spark):
    long = "/data/" + "a" * 300_000 + "/run_m1-2.x.csv"
    rows = spark.createDataFrame([(long,), ("b/c.csv",), ("d.csv",), ("e/",), (None,)], "file string").cache()
    rows.count()
    t = time.time()
    got = rows.select(IO.file_stem(F.col("file")).alias("s"), F.length(IO.parent_folder(F.col("file"))).alias("p")).collect()
    assert [tuple(r) for r in got] == [("run_m1-2.x", 300_000), ("c", 1), ("d", 0), ("", 1), (None, None)]
    tags = IO.with_run_tag(rows, prefix="run_").select("model_key", "run_id").first()
    assert tuple(tags) == ("m1-2.x", -1) and time.time() - t < 10


def test_noise_levels_train_on_as_few_partitions_as_their_bytes_need(spark, monkeypatch):
    seen = []

    class Watched(B.LogisticRegression):
        def fit(self, df, *args):
            seen.append((df.rdd.getNumPartitions(), threading.get_ident()))
            return super().fit(df, *args)

    monkeypatch.setattr(B, "LogisticRegression", Watched)
    words = {"a": "red apple", "b": "blue boat"}
    rows = spark.createDataFrame([(i, words["ab"[i % 2]], "ab"[i % 2]) for i in range(40)], "doc_id long, text string, lang string")
    got = B.noise_robustness(rows, pcts=[5, 10], exclude="z").collect()
    assert [n for n, _ in seen] == [1, 1] and len({t for _, t in seen}) == 2
    assert [r["noise_pct"] for r in got] == [5] * 4 + [10] * 4 and all(r["value"] == 1.0 for r in got)


def test_first_per_key_orders_and_keeps_rows_whole(spark):
    rows = spark.createDataFrame([(1, 2, "x", None), (1, 1, "y", 5), (1, 1, "y", None), (2, None, "z", 1), (2, 0, "a", 1),
                                  (None, 3, "n", 3)], "k int, o int, v string, w int")
    # "o" is an order column and a value
    got = {r["k"]: tuple(r)[1:] for r in first_per_key(rows, ["k"], ["o"], ["v", "w", "o"]).collect()}
    assert got == {1: ("y", None, 1), 2: ("z", 1, None), None: ("n", 3, 3)}
    plan = first_per_key(rows, ["k"], ["o"], ["v", "w"])._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in plan  # one struct is carried and sorted, not two


def test_kept_vehicles_are_read_back_and_the_same(spark, tmp_path):
    spark.range(0, 400).selectExpr("id % 100 as l_orderkey", "cast(id % 3 as int) as l_linenumber", "id * 7 % 50 as l_partkey",
                                   "id % 5 as l_suppkey", "cast(id as double) as l_extendedprice", "date'2020-01-01' as l_shipdate"
                                   ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(0, 100).selectExpr("id as o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    plain, kept = Views(spark, str(tmp_path)), Views(spark, str(tmp_path)).kept_vehicles()
    for name in ("gv", "vpred"):
        a, b = getattr(plain, name), getattr(kept, name)
        assert a.count() and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
        assert not any("lineitem" in f for f in b.inputFiles())
