"""Whole queries over the smallest tables against plain versions, and the pipeline."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from tests.llm import brute
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()


@pytest.fixture(scope="module")
def items():
    return duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()


def result(spark, name):
    return {r["doc_id"]: r.asDict() for r in E.queries()[name](spark, SF).collect()}


def test_every_number_is_registered():
    names = {n.split("_")[0] for n in E.queries() if n.startswith("op")}
    assert names == {f"op{i}" for i in range(1, 14)} and "pipeline" in E.queries()


def test_op1(spark, texts):
    got = result(spark, "op1_pii")
    for i, t in texts:
        base = brute.base_spans(t)
        said = [f"{k}:{a}:{b}" for k, a, b in base]
        assert got[i]["base_sha256"] == brute.sha(",".join(said))
        assert set(said) <= set(got[i]["spans"].split(","))


def test_op2(spark, texts):
    got = result(spark, "op2_repeated_bytes")
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == brute.repeats(texts)


def test_op4(spark, texts):
    got = result(spark, "op4_near_dedup")
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == brute.near(texts, 2)


def test_op5(spark, texts):
    got = result(spark, "op5_exact_dedup")
    assert {i: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for i, r in got.items()} == brute.exact(texts)


def test_op5_on_repeated_ids(spark, tmp_path):
    rows = [(1, "a b"), (1, "zz"), (2, "zz"), (2, "zz"), (3, None), (4, " "), (5, "alone"), (None, "zz")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {}
    for r in E.queries()["op5_exact_dedup"](spark, str(tmp_path)).collect():
        assert r["doc_id"] not in got
        got[r["doc_id"]] = (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"])
    # a repeated id is one document, the one with the greatest text
    assert got == brute.exact([(1, "zz"), (2, "zz"), (3, None), (4, " "), (5, "alone")])


def test_op10(spark, texts, items):
    got = result(spark, "op10_decontaminate")
    assert {i: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for i, r in got.items()} \
        == brute.contaminated(texts, items)


def test_pipeline_stage_by_stage(spark, items, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontaminate", "mix", "tokens"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, SF)
        if name != "tokens":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r["doc_id"] for r in docs.collect()}
        seen[name] = before, after
    before, after = seen["toxicity"]
    assert len(toxic & after) <= 0.2 * len(toxic)
    before, after = seen["near_dedup"]
    near = brute.near(list(before.items()), 5)
    assert after == {i for i, v in near.items() if v[2]}
    before, after = seen["decontaminate"]
    assert after == {i for i, v in brute.contaminated(list(before.items()), items).items() if not v[4]}
    before, after = seen["tokens"]
    assert after == set(before) and docs.agg(F.sum("n_tokens")).first()[0] > 0
    assert docs.filter("start = 0").count() == 1


def test_pipeline_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 50


@pytest.mark.parametrize("key", ["op4_near_dedup", "op5_exact_dedup", "op9_mix_sources", "op10_decontaminate"])
def test_sql(spark, key):
    r = compare(spark, key, E.queries()[key], E.oracle_sql()[key], SF, duck(SF))
    assert r["ok"], r
