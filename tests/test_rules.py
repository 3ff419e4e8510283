"""Rules that a plausible shortcut would break: duplicates, missing votes and
labels, first matches, exact counts at size."""

import math

import pytest

from tallyspark.operators import agree as A
from tallyspark.operators import codes as C
from tallyspark.operators import metrics as M
from tallyspark.operators import relate as R
from tallyspark.operators import sample as S
from tallyspark.operators import text as T
from tallyspark.operators import vehicle as V
from tallyspark.operators.ranking import row_number_within
from tallyspark.sources import io as IO

VEH = "caseid long, vehno int, crashcat int, crashconf string, crashtype int"
CASE = "caseid long, vehicles int, summary string"


def test_case_without_any_label_scores_zero(spark):
    truth = spark.createDataFrame([(1, 1, 1, "A", None), (2, 1, 1, "A", 5)], VEH)
    pred = spark.createDataFrame([(1, 1, 1, "A", None), (2, 1, 1, "A", 5)], VEH)
    cases = spark.createDataFrame([(1, 1, "x"), (2, 2, "y"), (2, 9, "z"), (3, 1, "no truth")], CASE)
    got = {r["caseid"]: (r["vehicles"], r["summary"], r["case_accuracy"]) for r in V.case_accuracy(cases, truth, pred).collect()}
    assert got == {1: (1, "x", 0.0), 2: (2, "y", 0.5)}


def test_repeated_prediction_counts_as_one_whole_row(spark):
    truth = spark.createDataFrame([(1, 1, 1, "B", 9)], VEH)
    pred = spark.createDataFrame([(1, 1, 1, "A", 9), (1, 1, 0, "B", 3)], VEH)
    r = V.vehicle_correctness(truth, pred).collect()
    assert len(r) == 1 and (r[0]["p_crashcat"], r[0]["p_crashconf"], r[0]["p_crashtype"]) == (0, "B", 3)
    assert not r[0]["exact_ok"] and r[0]["conf_ok"]
    e = V.vehicle_eval(truth, pred).first()
    assert (e["n_truth"], e["n_pred"], e["matched"]) == (1, 1, 1)
    assert V.extra_predictions(truth.limit(0), pred).count() == 1
    d = {x["status"]: x["pred_text"] for x in V.case_report_detail(truth, pred).collect()}
    assert d == {"matched": "(1, 1, 0, B, 3)"}


def test_sample_without_vote_stays(spark):
    long = spark.createDataFrame([(1, "a", 4, 4), (1, "b", 4, 4), (2, "a", None, 5)], "sid long, r string, pred int, gt int")
    per = {r["sid"]: r for r in A.sample_consistency(long, ["sid"], "pred", truth="gt").collect()}
    assert (per[2]["n_votes"], per[2]["sample_consistency"], per[2]["sample_consistency_with_gt"]) == (0, None, None)
    assert per[1]["sample_consistency"] == 1.0
    assert A.overall_consistency(A.sample_consistency(long, ["sid"], "pred", truth="gt"), "gt").first()["n_samples"] == 2


def test_no_cells_for_a_run_that_a_model_lacks(spark):
    rows = [(1, "a", 1, 0), (1, "a", 2, 0), (1, "b", 1, 3)]
    df = spark.createDataFrame(rows, "sid long, model string, run int, pred int")
    got = A.pairwise_agreement(df, ["sid"], "run", "pred", by=["model"], raters=["1", "2"]).collect()
    assert sorted((r["rater_a"], r["rater_b"]) for r in got if r["model"] == "b") == [("1", "1")]
    assert len([r for r in got if r["model"] == "a"]) == 4


def test_majority_tie_goes_to_the_earliest_run_of_any_size(spark):
    big = 20_240_101_123_456
    df = spark.createDataFrame([(1, big + 1, 5), (1, big, 2)], "sid long, run long, pred int")
    assert A.majority_vote(df, ["sid"], "pred", "run").first()["maj_pred"] == 2


def test_lookup_returns_each_row_once(spark):
    gv = spark.createDataFrame([(1, 1, 2, "A", 1), (1, 1, 1, "B", 2)], VEH)
    df = spark.createDataFrame([(1, 1)], "caseid long, vehno int")
    assert [r["crashconf"] for r in R.lookup_truth(df, gv, ["crashcat"]).collect()] == ["B"]
    with pytest.raises(TypeError):
        R.lookup_truth(df, gv)


def test_single_vehicle_detail_checks_eligibility(spark):
    book = spark.createDataFrame([("A", 0)], "conf string, code_offset int")
    gv = spark.createDataFrame([(1, 1, 1, "A", 1), (2, 1, None, "A", 1), (3, 1, 9, "A", 1), (4, 1, 1, "Z", 1)], VEH)
    cases = spark.createDataFrame([(i, 1, "s") for i in range(1, 5)], CASE)
    assert [r["caseid"] for r in R.single_vehicle_detail(cases, gv, gv, book).collect()] == [1]


def test_type_task_keeps_unknown_categories(spark):
    book = spark.createDataFrame([("A", 0)], "conf string, code_offset int")
    gv = spark.createDataFrame([(1, 1, None, "A", 1), (2, 1, 9, "A", 1), (3, 1, 1, "A", None)], VEH)
    cases = spark.createDataFrame([(i, 1, "V1 hit") for i in range(1, 4)], CASE)
    opts = spark.createDataFrame([("A", "{}")], "conf string, options string")
    assert sorted(r["caseid"] for r in T.sft_type(cases, gv, opts, book, []).collect()) == [1, 2]
    assert T.sft_category(cases, gv, []).count() == 1


def test_metric_rows_only_in_their_exact_form(spark, tmp_path):
    rows = [("Metrics Road: V1 hit V2", "1", "2"), ("METRICS (ALL)", "accuracy", "0.9"), ("METRICS (ALL)", "1", "2"), ("ok", " 5 ", None)]
    for run in (1, 2):
        spark.createDataFrame(rows, "SUMMARY string, MANCOLL string, pred string").write.parquet(f"{tmp_path}/m-{run}")
    spark.createDataFrame([("x", "1", "1")], "summary string, label string, output string").write.parquet(f"{tmp_path}/n-1")
    got = IO.read_prediction_runs(spark, [f"{tmp_path}/m-*", f"{tmp_path}/n-1"]).collect()
    assert sorted(r["summary"] for r in got) == ["METRICS (ALL)"] * 2 + ["Metrics Road: V1 hit V2"] * 2 + ["ok"] * 2 + ["x"]
    assert {r["gt"] for r in got if r["summary"] == "ok"} == {"5"}
    with pytest.raises(ValueError):
        IO.read_prediction_runs(spark, [f"{tmp_path}/n-1", f"{tmp_path}/n-1"], unique=["summary"])
    with pytest.raises(FileNotFoundError):
        IO.read_prediction_runs(spark, [f"{tmp_path}/none-*"])


def test_columns_name_themselves():
    al = {"gt": ["MANCOLL", "label"], "pred": ["pred"]}
    assert IO.canonical_columns(["Label", "PRED", "x"], al) == {"gt": "Label", "pred": "PRED"}
    assert IO.canonical_columns(["label", "Mancoll"], al)["gt"] == "label"
    with pytest.raises(ValueError):
        IO.canonical_columns(["LABEL", "Mancoll"], al)


def test_kappa_of_counts_beyond_bigint_squares(spark):
    n = 4 * 10**10
    stats = spark.createDataFrame([("g", 2, n, float(n) * 0.75)], "g string, n_i long, n long, p double")
    labels = spark.createDataFrame([("g", 2, 1, n), ("g", 2, 2, n)], "g string, n_i long, l int, t long")
    r = A.kappa_from_counts(stats, labels, ["g"], True).first()
    assert (r["n_votes"], r["kappa"]) == (2 * n, 0.5)


def test_quotas_of_counts_beyond_bigint_products(spark):
    counts = {1: 1_311_830_433, 2: 20_061_618_709 - 1_311_830_433 - 7, 3: 7}
    n = sum(counts.values())
    total = -(-n * 20 // 100)
    base = {k: c * total // n for k, c in counts.items()}
    order = sorted(counts, key=lambda k: (-(counts[k] * total % n), k))
    want = {k: base[k] + (order.index(k) < total - sum(base.values())) for k in counts}
    df = spark.createDataFrame(list(counts.items()), "c int, _nc long")
    assert {r["c"]: r["_cut_0"] for r in S.quotas_from_counts(df, "c", 20).collect()} == want


def test_floor_pct_is_exact(spark):
    n = 9_007_199_254_740_993 * 9
    df = spark.createDataFrame([(n,)], "n long")
    assert df.select(S.floor_pct(df.n, 15), S.ceil_pct(df.n, 15)).first()[:] == (n * 15 // 100, -(-n * 15 // 100))


def test_row_numbers_across_partition_edges(spark):
    df = spark.createDataFrame([("hot" if i % 3 else f"g{i}", i) for i in range(300)], "g string, i long")
    got = row_number_within(df, ["g"], ["i"], "rn", partitions=7, total="m").collect()
    hot = sorted((r["i"], r["rn"], r["m"]) for r in got if r["g"] == "hot")
    assert [x[1] for x in hot] == list(range(1, 201)) and {x[2] for x in hot} == {200}
    assert all(r["rn"] == r["m"] == 1 for r in got if r["g"] != "hot")
    assert dict(row_number_within(df, ["g"], ["i"], "rn").dtypes)["rn"] == "bigint"


def test_unseen_label_raises(spark):
    df = spark.createDataFrame([("a",), ("z",)], "l string")
    seen = spark.createDataFrame([("a", 0)], "label string, label_id int")
    assert C.apply_encoding(df.limit(1), "l", seen).count() == 1
    with pytest.raises(Exception, match="unseen label"):
        C.apply_encoding(df, "l", seen).collect()


def test_scores_come_from_one_confusion_table(spark):
    df = spark.createDataFrame([(1, 1), (1, 9), (9, 9), (2, 1), (None, 1)], "gt int, pred int")
    got = {(r["scope"], r["metric"]): r["value"] for r in M.metrics_table(df, "gt", "pred").collect()}
    assert got["overall", "accuracy"] == 0.5 and math.isclose(got["excl_9", "accuracy"], 0.333333)
    p = M.metrics_table(df, "gt", "pred")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in p


def test_text_with_control_characters_is_not_cut(spark):
    df = spark.createDataFrame([(1, "lead\x01 Vehicle 1 a\x01b Vehicle 2 c")], "caseid long, summary string")
    got = [(r["pos"], r["segment"], r["vehno_text"]) for r in T.split_by_vehicle(df).orderBy("pos").collect()]
    assert got == [(1, "Vehicle 1 a\x01b", "1"), (2, "Vehicle 2 c", "2")]


def test_baselines_on_separable_rows(spark):
    from tallyspark.operators import baseline as B
    from tallyspark.operators.predict import centroid_predictor, predict_table
    from pyspark.sql import types as ST
    emb = spark.createDataFrame([(i, [float(i % 3 == j) + (i % 7) / 100 for j in range(3)], i % 3) for i in range(90)],
                                "vec_id long, embedding array<double>, label int")
    acc = {(r["scope"], r["metric"]): r["value"] for r in B.embedding_lr(emb).collect()}
    assert acc["overall", "accuracy"] == 1.0
    p = predict_table(emb, centroid_predictor(emb, "embedding", "label"), "pred", ST.IntegerType(), ["embedding"])
    assert p.where("pred <> label").count() == 0 and p.columns == ["vec_id", "embedding", "label", "pred"]
    word = {0: "alpha", 1: "beta"}
    docs = spark.createDataFrame([(i, f"{word[i % 2]} common w{i % 5}", word[i % 2]) for i in range(60)],
                                 "doc_id long, text string, lang string")
    new = spark.createDataFrame([(1, "alpha x", "unseen"), (2, "beta y", "beta")], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["pred_lang"] for r in B.bow_linear(docs, new, weighted=True).collect()} == {1: "alpha", 2: "beta"}
    levels = B.noise_robustness(docs, pcts=[5, 20]).collect()
    assert len(levels) == 8
    assert all(r["value"] == 1.0 for r in levels if r["metric"] == "accuracy" and r["noise_pct"] == 5)


def test_lookup_reduces_only_truth_rows_asked_for(spark):
    gv = spark.createDataFrame([(1, 1, 3, "B", 5), (1, 1, 2, "A", 4), (2, 1, 1, "C", 6), (None, 1, 1, "D", 7)],
                               "caseid long, vehno int, crashcat int, crashconf string, crashtype int")
    df = spark.createDataFrame([(1, 1), (1, 1), (3, 1), (None, 1)], "caseid long, vehno int")
    out = R.lookup_truth(df, gv, ["crashcat"])
    got = sorted(((r["caseid"], r["crashconf"]) for r in out.collect()), key=str)
    assert got == [(1, "A"), (1, "A"), (3, None), (None, None)]
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()


def test_sft_examples_derive_the_options_once(spark):
    out = __import__("__spark_entry__").queries()["sft_examples"](spark, "/root/testdata/sf0.001")
    # the final query reads lineitem for the labels alone, the options as they were written
    assert sum("lineitem.parquet" in f for f in out.inputFiles()) == 1
    assert any("/options-" in f for f in out.inputFiles())
