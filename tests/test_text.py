from pyspark.sql import functions as F

from tallyspark.operators import codes as C
from tallyspark.operators import text as T
from tallyspark.sources import io as IO


def col_values(df, c):
    return [r[c] for r in df.collect()]


def test_parse_digit(spark):
    df = spark.createDataFrame([("The answer is 4.",), ("42",), ("",), (None,)], "a string")
    assert col_values(T.parse_responses(df, "a", "digit"), "parsed") == [4, 9, 9, 9]


def test_parse_first_digit(spark):
    df = spark.createDataFrame([("The answer is 4.",), ("42",), ("112",), ("",)], "a string")
    assert col_values(T.parse_responses(df, "a", "leading_digit"), "parsed") == [4, 4, 1, 9]


def test_parse_symbol(spark):
    df = spark.createDataFrame([("class A",), ("Angle 3",), ("112",), ("",)], "a string")
    assert col_values(T.parse_responses(df, "a", "symbol"), "parsed") == [10, 3, 12, None]


def test_parse_letter(spark):
    df = spark.createDataFrame([("Answer: C",), ("none",), ("AB",)], "a string")
    assert col_values(T.parse_responses(df, "a", "letter"), "parsed") == ["C", None, None]


def test_focus_vehicle(spark):
    x = "the vehicle to be classified"
    df = spark.createDataFrame([
        (1, "v1 hit Vehicle #2 and V#1, then V10 and Vehicle 1. (V1)"),
        (10, "V1 V10 étéV10 vehicle 10")], "vehno int, summary string")
    out = col_values(T.focus_vehicle(df), "focus_text")
    assert out == [f"{x} hit Vehicle #2 and {x}, then V10 and {x}. ({x})", f"V1 {x} étéV10 {x}"]


def test_split_by_vehicle(spark):
    df = spark.createDataFrame([(1, "Pre. Vehicle 1 was\nslow. Vehicle2 hit it.\n")], "caseid long, summary string")
    segs = [r["segment"] for r in T.split_by_vehicle(df).orderBy("pos").collect()]
    assert segs == ["Vehicle 1 was\nslow.", "Vehicle2 hit it."]


def test_parse_options(spark):
    df = spark.createDataFrame([("A", "{1: 'Rear end',\n    2: 'A\\'s'}"), ("B", "bad{")], "conf string, options string")
    rows, fails = C.parse_options(df)
    got = sorted((r["conf"], r["code"], r["meaning"]) for r in rows.collect())
    assert got == [("A", 1, "Rear end"), ("A", 2, "A's")]
    f = fails.collect()[0]
    assert (f["n_failed"], f["n_total"]) == (1, 2)


def test_local_symbol(spark):
    df = spark.createDataFrame([(3,), (10,), (13,)], "k int")
    assert col_values(df.select(C.local_symbol(F.col("k")).alias("s")), "s") == ["3", "A", "D"]


def test_argmax_first_max(spark):
    df = spark.createDataFrame([([0.1, 0.7, 0.7],)], "v array<double>")
    assert col_values(T.argmax_class(df, "v"), "pred_index") == [1]


def test_normalise_labels(spark):
    df = spark.createDataFrame([(" a ",), ("5.0",), ("7",)], "x string")
    assert col_values(C.normalise_labels(df, ["x"]), "x") == ["a", "5", "7"]


def test_run_tag(spark):
    df = spark.createDataFrame([("/p/bert_test_results_845-4.xlsx",), ("llama.xlsx",)], "file string")
    got = [(r["model_key"], r["run_id"]) for r in IO.with_run_tag(df).collect()]
    assert got == [("845", 4), ("llama", -1)]


def test_vocab_and_tokens(spark):
    df = spark.createDataFrame([(1, "b a b"), (2, "c  B\tz"), (3, "")], "doc_id long, text string")
    v = T.build_vocab(df, "text", k=2)
    assert [(r["word"], r["id"], r["n"]) for r in v.orderBy("id").collect()] == [("b", 2, 3), ("a", 3, 1)]
    enc = {r["doc_id"]: r["token_ids"] for r in T.encode_tokens(df, v, "text").collect()}
    assert enc == {1: [2, 3, 2], 2: [1, 2, 1], 3: []}


def test_with_cache(spark):
    p = spark.createDataFrame([("x",), ("x",), ("y",)], "prompt string")
    cache = spark.createDataFrame([("x", "1")], "p string, answer string").select(
        F.md5("p").alias("prompt_key"), "answer")
    got = sorted((r["prompt"], r["answer"], r["cached"]) for r in T.with_cache(p, cache).collect())
    assert got == [("x", "1", True), ("y", None, False)]


def test_sample_id_occurrence_unique(spark):
    rows = [("m", 1, i, "*", 5) for i in range(50)] + [("m", 1, 100, "x", 5)]
    df = spark.createDataFrame(rows, "model string, run int, row int, summary string, gt int")
    out = C.with_sample_id(df, "summary", "gt", ["model", "run"], ["row"])
    ids = [r["sample_id"] for r in out.collect()]
    assert len(set(ids)) == 51
    IO.assert_unique(out, ["model", "run", "sample_id"])
    import pytest
    with pytest.raises(ValueError):
        IO.assert_unique(df, ["model", "run", "summary"])


def test_prompts_of_vehicles_still_to_be_classified(spark):
    cases = spark.createDataFrame([(1, "V1 hit V2.", 2), (2, None, 1), (3, "x", 0)], "caseid long, summary string, vehicles int")
    got = {(r["caseid"], r["vehno"]): r["prompt"] for r in T.vehicle_prompts(cases, "category").collect()}
    assert sorted(got) == [(1, 1), (1, 2), (2, 1)]
    assert "the vehicle to be classified hit V2." in got[1, 1] and "vehicle 2" in got[1, 2] and '\"\"\"\"\"\"' in got[2, 1]
    known = spark.createDataFrame([(1, 1, 2, "B"), (1, 1, 1, "C"), (1, 2, 9, "A"), (2, 1, None, None), (7, 1, 1, "A")],
                                  "caseid long, vehno int, crashcat int, crashconf string")
    letters = spark.createDataFrame([(1, "A: a\nB: b", "Note on A: n"), (2, "C: c", ""), (9, "Z: z", "")],
                                    "category int, option_text string, note string")
    got = {(r["caseid"], r["vehno"]): r["prompt"] for r in T.vehicle_prompts(cases, "configuration", known, letters).collect()}
    assert sorted(got) == [(1, 1)] and "A: a\nB: b\nNote on A: n\n" in got[1, 1]
    types = spark.createDataFrame([("A", "{1: 'x'}"), ("B", "{2: 'y'}")], "conf string, options string")
    got = {(r["caseid"], r["vehno"]): r["prompt"] for r in T.vehicle_prompts(cases, "type", known, types).collect()}
    assert sorted(got) == [(1, 1), (1, 2)] and "{2: 'y'}" in got[1, 1] and "{1: 'x'}" in got[1, 2]


def test_failure_rate_of_every_rule(spark):
    df = spark.createDataFrame([(0, "4"), (0, "none"), (1, "class A"), (1, None)], "model int, a string")
    want = {"digit": {0: 0.5, 1: 1.0}, "leading_digit": {0: 0.5, 1: 1.0}, "letter": {0: 1.0, 1: 0.5}, "symbol": {0: 0.5, 1: 0.5}}
    for rule, rates in want.items():
        assert {r["model"]: r["failure_rate"] for r in T.parse_failure_rate(df, "a", rule, ["model"]).collect()} == rates
