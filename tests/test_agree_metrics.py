import pytest

from tallyspark.operators import agree as A
from tallyspark.operators import metrics as M


def test_majority_vote_tie_first_run(spark):
    df = spark.createDataFrame([(1, 1, "B"), (1, 2, "A"), (1, 3, None)], "sid long, run int, pred string")
    r = A.majority_vote(df, ["sid"], "pred", "run").collect()[0]
    assert (r["maj_pred"], r["consistency"], r["n_votes"]) == ("B", 0.5, 2)


def test_sample_consistency(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (2, "b", 1), (2, "c", 2)],
                               "sid long, rater string, pred int")
    got = {r["sid"]: r["sample_consistency"] for r in A.sample_consistency(df, ["sid"], "pred").collect()}
    assert got == {1: None, 2: pytest.approx(0.666667)}


def test_fleiss_all_agree(spark):
    rows = [(s, r, s % 2) for s in range(10) for r in ("a", "b", "c")]
    df = spark.createDataFrame(rows, "sid long, rater string, pred long")
    r = A.fleiss_kappa(df, ["sid"], "pred").collect()[0]
    assert r["kappa"] == 1.0 and r["equal_votes"]


def test_fleiss_textbook(spark):
    # Fleiss (1971)-style small table: 4 samples, 3 raters, 2 categories.
    table = [[3, 0], [2, 1], [1, 2], [0, 3]]
    rows = []
    for s, counts in enumerate(table):
        r = 0
        for lab, n in enumerate(counts):
            for _ in range(n):
                rows.append((s, f"r{r}", lab))
                r += 1
    df = spark.createDataFrame(rows, "sid long, rater string, pred long")
    k = A.fleiss_kappa(df, ["sid"], "pred").collect()[0]["kappa"]
    n, N = 3, 4
    P = sum((sum(c * c for c in row) - n) / (n * (n - 1)) for row in table) / N
    pj = [sum(row[j] for row in table) / (N * n) for j in range(2)]
    pe = sum(p * p for p in pj)
    assert k == pytest.approx(round((P - pe) / (1 - pe), 6))


def test_pairwise_symmetric_diag(spark):
    rows = [(s, r, (s * (i + 1)) % 3) for s in range(30) for i, r in enumerate(("a", "b", "c"))]
    df = spark.createDataFrame(rows, "sid long, rater string, pred long")
    pw = {(r["rater_a"], r["rater_b"]): r["agreement"] for r in
          A.pairwise_agreement(df, ["sid"], "rater", "pred").collect()}
    for (a, b), v in pw.items():
        assert v == pw[(b, a)]
        if a == b:
            assert v == 1.0


def test_metrics_excl_class(spark):
    df = spark.createDataFrame([(1, 1), (1, 9), (9, 9)], "gt int, pred int")
    r = M.metrics_excl_class(df, "gt", "pred").collect()[0]
    assert r["accuracy"] == 0.5 and r["macro_f1"] == pytest.approx(0.333333)


def test_confusion_rows_sum_to_one(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (4, 4), (4, 1)], "gt int, pred int")
    cm = M.confusion_matrix(df, "gt", "pred", [1, 2, 4, 5])
    sums = {}
    for r in cm.collect():
        sums[r["gt"]] = sums.get(r["gt"], 0) + r["share"]
    assert sums[1] == pytest.approx(1) and sums[2] == pytest.approx(1) and sums[4] == pytest.approx(1)
    assert sums[5] == 0


def test_class_report_rows(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2)], "gt int, pred int")
    rep = {r["row"]: r for r in M.class_report(df, "gt", "pred").collect()}
    assert rep["1"]["precision"] == 1.0 and rep["1"]["recall"] == 0.5
    assert rep["accuracy"]["f1"] == pytest.approx(0.666667) and rep["accuracy"]["support"] == 3


def test_pairwise_of_many_raters(spark):
    k = 30
    vote = {(s, i): ((s * (i + 3)) % 4 if (s + i) % 5 else None) for s in range(40) for i in range(k)}
    vote.update({(s, 7): None for s in range(40)})  # a rater without a vote has no cells
    df = spark.createDataFrame([(s, f"r{i}", v) for (s, i), v in vote.items()], "sid long, rater string, pred long")
    wide = A.merge_predictions(df, ["sid"], "rater", "pred", [f"r{i}" for i in range(k)])
    got = {(r["rater_a"], r["rater_b"]): (r["n_both"], r["n_equal"]) for r in A.pairwise_from_wide(
        wide, [f"r{i}" for i in range(k)]).collect()}
    want = {}
    for i in range(k):
        for j in range(k):
            both = [s for s in range(40) if vote[s, i] is not None and vote[s, j] is not None]
            if i != 7 and j != 7:
                want[f"r{i}", f"r{j}"] = (len(both), sum(vote[s, i] == vote[s, j] for s in both))
    assert got == want
