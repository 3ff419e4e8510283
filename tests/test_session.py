from tallyspark.session import cluster_conf, ensure_checkpoint_dir, scratch_path, spread


def test_checkpoint_dir_is_kept_and_scratch_is_fresh(spark):
    d = ensure_checkpoint_dir(spark)
    assert d and ensure_checkpoint_dir(spark) == d
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(spark.conf.get("spark.checkpoint.dir").rstrip("/"))


def test_cluster_conf_scales_with_input():
    small = cluster_conf(10 << 30, 64)
    big = cluster_conf(100 << 40, 8000)
    assert int(small["spark.sql.shuffle.partitions"]) == 128
    assert int(big["spark.sql.shuffle.partitions"]) == 409600
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"


def test_spread_only_small_tables(spark):
    few = spark.range(0, 100, 1, 1)
    assert spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(few, most=10).rdd.getNumPartitions() == 1


def test_dealt_rows_of_a_task_do_not_grow_with_the_table(spark, tmp_path):
    from tallyspark.session import dealt
    for n in (1, 4):
        path = str(tmp_path / f"t{n}")
        spark.range(n * 50_000).selectExpr("id % 7919 * 7907 + id AS k", "1 AS v").write.parquet(path)
        df = dealt(spark.read.parquet(path), "k", 20_000)
        sizes = [len(p) for p in df.rdd.glom().collect()]
        assert max(sizes) < 30_000 / 4 * 2 and sum(sizes) == n * 50_000
