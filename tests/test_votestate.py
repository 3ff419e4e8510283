"""Vote counts as a stored state: runs are added once, earlier ones are not read again."""

import os
import re

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import agree
from tallyspark.operators.votestate import VoteState
from tallyspark.session import scratch_path

ROWS = [("a", 1, 1, 1), ("a", 1, 1, 2), ("a", 1, 2, 3), ("b", 2, None, 1), ("b", 2, None, 2), ("c", None, 3, 1), ("c", None, 4, 2),
        ("c", None, 4, 3), ("d", 5, 6, 3), ("a", 1, 1, 1)]


def rows(df):
    return sorted(map(str, df.collect()))


def test_runs_added_one_by_one_equal_all_at_once(spark):
    votes = spark.createDataFrame(ROWS, "sid string, gt int, pred int, run int")
    state = VoteState(scratch_path(spark, "votes"), ("sid",), "pred", "gt")
    with pytest.raises(FileNotFoundError):
        state.counts(spark)
    for upto, r in enumerate((2, 1, 3), 1):
        assert state.add(votes.where(F.col("run") == r), f"r{r}")
        assert not state.add(votes, f"r{r}")  # a replay, whatever it brings
        so_far = votes.where(F.col("run").isin([2, 1, 3][:upto]))
        assert rows(state.consistency(spark)) == rows(agree.sample_consistency(so_far, ["sid"], "pred", "gt"))
    assert sorted(r["run"] for r in state.runs(spark).collect()) == ["r1", "r2", "r3"]
    state.prune(spark, 1)
    assert state.versions(spark) == [3]
    assert rows(state.consistency(spark)) == rows(agree.sample_consistency(votes, ["sid"], "pred", "gt"))


def test_a_version_counts_from_its_commit_on(spark):
    votes = spark.createDataFrame(ROWS, "sid string, gt int, pred int, run int")
    state = VoteState(scratch_path(spark, "votes"), ("sid",), "pred")
    state.add(votes.where("run = 1"), "r1")
    state.add(votes.where("run = 2"), "r2")
    os.remove(state.path.removeprefix("file:") + "/version=2/counts/_SUCCESS")  # as if the job had died
    assert state.versions(spark) == [1]
    assert state.add(votes.where("run = 2"), "r2") and state.versions(spark) == [1, 2]
    want = agree.sample_consistency(votes.where("run < 3"), ["sid"], "pred")
    assert rows(state.consistency(spark)) == rows(want)


def test_adding_a_run_reads_the_last_version_only(spark):
    votes = spark.createDataFrame(ROWS, "sid string, gt int, pred int, run int")
    state = VoteState(scratch_path(spark, "votes"), ("sid",), "pred")
    for r in (1, 2):
        state.add(votes.where(F.col("run") == r), f"r{r}")
    state.prune(spark, 1)  # nothing of the first is needed any more
    state.add(votes.where("run = 3"), "r3")
    files = {f.split("version=")[1][0] for f in state.counts(spark).inputFiles()}
    assert files == {"3"} and rows(state.consistency(spark)) == rows(agree.sample_consistency(votes, ["sid"], "pred"))


def test_histogram_of_several_columns(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.5, 1.0), (1.0, None), (0.26, 1.0)], "a double, b double")
    got = {(r["metric"], r["bin"]): r["n"] for r in agree.consistency_histogram(df, ["a", "b"], 4).collect()}
    assert got == {("a", 0): 1, ("a", 1): 1, ("a", 2): 1, ("a", 3): 1, ("b", 0): 3}
    assert agree.consistency_histogram(df.where("a > 2"), ["a", "b"], 4).count() == 0
    df = agree.consistency_histogram(df, ["a", "b"], 4)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    run = set(re.findall(r"(?<!ReusedSubquery )Subquery subquery#(\d+)", final))
    assert len(run) == 1, final  # all ranges by one aggregate, reused wherever they are named
