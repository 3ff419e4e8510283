"""Plan-shape checks on registered queries: filters reach the scan, no
Python in the JVM-side families, no cartesian products."""

import pytest

import __spark_entry__ as E

JVM_ONLY = ["self_consistency", "pairwise_agreement", "fleiss_kappa", "macro_f1", "lookup_truth",
            "vehicle_eval_type", "focus_vehicle", "build_vocab", "inject_label_noise", "random_split",
            "stratified_split", "noise_ladder", "confusion_matrix", "majority_vote", "encode_tokens",
            "vehicle_overall", "metrics_table", "metrics_excl_class", "accuracy", "case_accuracy", "class_report",
            "run_pairwise", "accuracy_vs_gt", "sample_consistency_gt", "truth_list", "sft_examples", "apply_encoding"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", JVM_ONLY)
def test_no_python_no_cartesian(spark, key):
    p = plan(E.queries()[key](spark, "/root/testdata/sf0.001"))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_column_pruning_reaches_scan(spark):
    df = E.queries()["self_consistency"](spark, "/root/testdata/sf0.001")
    p = plan(df)
    assert "ReadSchema: struct<o_orderkey:bigint>" in p
