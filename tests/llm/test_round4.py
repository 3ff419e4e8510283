"""What the review of round 4 found in the training-data operators."""

from pyspark.sql import functions as F

from tallyspark.llm import common as C
from tallyspark.llm import decontam as D


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_found_places_are_never_broadcast(spark):
    words = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(i, words if i % 2 else "clean text") for i in range(40)], "doc_id long, text string")
    items = spark.createDataFrame([(1, words)], "item_id long, text string")
    out = D.decontaminate(docs, items)
    # their files are a few KB: a join by the size of its files would take them for small
    joins = [x for x in executed(out).splitlines() if "Join" in x and "doc_id" in x and "LeftOuter" not in x and "LeftSemi" not in x]
    assert joins and all("SortMergeJoin" in x for x in joins)
    got = {r["doc_id"]: (r["n_hit"], r["contaminated"], len(r["matches"] or [])) for r in out.collect()}
    assert got == {i: (20, True, 8) if i % 2 else (0, False, 0) for i in range(40)}
    near = D.proximity_matches(docs, items, slop=0)
    assert "SortMergeJoin" in executed(near) and near.count() == 20 * 8


def test_tables_of_few_long_rows_are_not_broadcast(spark):
    rows = spark.range(4).select("id", F.repeat(F.lit("x"), C.BROADCAST_BYTES // 4).alias("text"),
                                 F.array(F.lit("a"), F.lit(None).cast("string")).alias("items"))
    assert not C.small_enough(rows, 100) and C.small_enough(rows.select("id", "items"), 100)
    assert not C.small_enough(rows.select(F.array("text").alias("items")), 100)
    assert not C.small_enough(rows.select("id"), 3) and C.small_enough(rows.filter("id < 0"), 3)
    assert "broadcast" in C.hinted(rows.select("id"), 4)._jdf.queryExecution().logical().toString().lower()
