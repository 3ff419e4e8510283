"""Registered agreement queries (A1–A12) over the ``pred_long`` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import agree
from tallyspark.operators.votestate import VoteState
from tallyspark.plans.registry import register
from tallyspark.plans.sqlkit import big, r6
from tallyspark.session import scratch_path
from tallyspark.sources.fixtures import MODELS, RUNS, Views, with_views

RATERS = [f"{m}_r{r}" for m, _ in MODELS for r in RUNS]


def cross_long(spark, sf_dir):
    """Every (model, run) as one rater over the same samples."""
    p = Views(spark, sf_dir).pred_long
    return p.withColumn("rater", F.concat(F.col("model"), F.lit("_r"), F.col("run").cast("string")))


R_CTE = ("r", "SELECT sid, gt, pred, model, run, model || '_r' || CAST(run AS VARCHAR) AS rater FROM pred_long")
RGT_CTE = ("rg", "SELECT sid, gt, pred, rater FROM r UNION ALL SELECT DISTINCT sid, gt, gt, 'GT' FROM r")


def _sql(body: str, extra=None) -> str:
    return with_views("pred_long", body, [R_CTE] + (extra or []))


def _pairs_sql(src: str, keys: list[str]) -> str:
    """Cells of raters that have a vote in the group, with what they share."""
    by = [k for k in keys if k != "sid"]
    sel, grp = "".join(f"{k}, " for k in by), "".join(f"a.{k}, " for k in by)
    same = " AND ".join(["TRUE", *(f"a.{k} = b.{k}" for k in by)])
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    voters = f"(SELECT DISTINCT {sel}CAST(rater AS VARCHAR) AS rater FROM {src} WHERE pred IS NOT NULL)"
    both = (f"SELECT {grp}CAST(a.rater AS VARCHAR) AS ra, CAST(b.rater AS VARCHAR) AS rb, count(*) AS nb, "
            f"count(*) FILTER (WHERE a.pred = b.pred) AS ne FROM {src} a JOIN {src} b ON {on} "
            f"WHERE a.pred IS NOT NULL AND b.pred IS NOT NULL GROUP BY {grp}a.rater, b.rater")
    hit = " AND ".join(["c.ra = a.rater", "c.rb = b.rater", *(f"c.{k} = a.{k}" for k in by)])
    return (f"SELECT {grp}a.rater AS rater_a, b.rater AS rater_b, coalesce(c.nb, 0) AS n_both, "
            f"coalesce(c.ne, 0) AS n_equal, CASE WHEN a.rater = b.rater THEN 1.0::DOUBLE "
            f"WHEN c.nb > 0 THEN {r6('c.ne / c.nb')} END AS agreement "
            f"FROM {voters} a JOIN {voters} b ON {same} LEFT JOIN ({both}) c ON {hit}")


# A1 -----------------------------------------------------------------------------
@register("merge_predictions", sql=_sql(
    "SELECT sid, gt, " + ", ".join(f"max(pred) FILTER (WHERE rater = '{x}') AS {x}" for x in RATERS)
    + " FROM r GROUP BY sid, gt"))
def q_merge_predictions(spark, sf_dir):
    return agree.merge_predictions(cross_long(spark, sf_dir), ["sid"], "rater", "pred", RATERS, keep=["gt"])


# A2 / A3 / A4 -----------------------------------------------------------------------
@register("pairwise_agreement", sql=_sql(_pairs_sql("r", ["sid"])))
def q_pairwise_agreement(spark, sf_dir):
    return agree.pairwise_agreement(cross_long(spark, sf_dir), ["sid"], "rater", "pred", raters=RATERS)


@register("pairwise_with_gt", sql=_sql(_pairs_sql("rg", ["sid"]), [RGT_CTE]))
def q_pairwise_with_gt(spark, sf_dir):
    return agree.pairwise_agreement(cross_long(spark, sf_dir), ["sid"], "rater", "pred",
                                    raters=RATERS, truth="gt")


@register("accuracy_vs_gt", sql=_sql(
    "SELECT rater_a AS rater, n_both, agreement AS accuracy_vs_gt FROM pw "
    "WHERE rater_b = 'GT' AND rater_a <> 'GT'", [RGT_CTE, ("pw", _pairs_sql("rg", ["sid"]))]))
def q_accuracy_vs_gt(spark, sf_dir):
    return agree.accuracy_vs_gt(agree.pairwise_agreement(
        cross_long(spark, sf_dir), ["sid"], "rater", "pred", raters=RATERS, truth="gt"))


# A5 / A6 / A7 / A12 -------------------------------------------------------------------
_PL = ("pl", "SELECT sid, gt, pred, count(pred) AS n FROM r GROUP BY ALL")
_SC = ("sc", "SELECT sid, gt, sum(n) AS tv, max(n) AS top, "
             "max(CASE WHEN pred = gt THEN n + 1 ELSE n END) AS top_gt FROM pl GROUP BY ALL")
_SCV = ("scv", "SELECT sid, gt, tv, CASE WHEN tv > 1 THEN top / tv END AS c, "
               "CASE WHEN tv + (CASE WHEN gt IS NOT NULL THEN 1 ELSE 0 END) > 1 THEN "
               "greatest(top_gt, CASE WHEN gt IS NOT NULL THEN 1 ELSE 0 END) / "
               "(tv + (CASE WHEN gt IS NOT NULL THEN 1 ELSE 0 END)) END AS cg FROM sc")


@register("sample_consistency", sql=_sql(
    f"SELECT sid, {big('sum(n)')} AS n_votes, CASE WHEN sum(n) > 1 THEN {r6('max(n) / sum(n)')} END "
    "AS sample_consistency FROM (SELECT sid, pred, count(pred) AS n FROM r GROUP BY ALL) "
    "GROUP BY sid"))
def q_sample_consistency(spark, sf_dir):
    return agree.sample_consistency(cross_long(spark, sf_dir), ["sid"], "pred")


@register("sample_consistency_gt", sql=_sql(
    f"SELECT sid, gt, {big('tv')} AS n_votes, {r6('c')} AS sample_consistency, "
    f"{r6('cg')} AS sample_consistency_with_gt FROM scv", [_PL, _SC, _SCV]))
def q_sample_consistency_gt(spark, sf_dir):
    return agree.sample_consistency(cross_long(spark, sf_dir), ["sid"], "pred", truth="gt")


@register("sample_consistency_state", sql=_sql(
    f"SELECT sid, gt, {big('tv')} AS n_votes, {r6('c')} AS sample_consistency, "
    f"{r6('cg')} AS sample_consistency_with_gt FROM scv", [_PL, _SC, _SCV]),
    note="the same from a stored state to which each run's votes are added, one of them twice")
def q_sample_consistency_state(spark, sf_dir):
    votes = scratch_path(spark, "votes")
    cross_long(spark, sf_dir).select("sid", "gt", "pred", "run").write.partitionBy("run").parquet(votes)
    state = VoteState(scratch_path(spark, "vote-state"), ("sid",), "pred", "gt")
    for r in [*RUNS, RUNS[0]]:
        state.add(spark.read.parquet(votes).where(F.col("run") == r), f"run-{r}")
    return state.consistency(spark)


@register("overall_consistency", sql=_sql(
    f"SELECT count(*) AS n_samples, {r6('avg(c)')} AS overall_consistency, "
    f"{r6('avg(CASE WHEN CAST(gt AS VARCHAR) <> ' + chr(39) + '9' + chr(39) + ' THEN c END)')} "
    f"AS overall_consistency_excl9, {r6('avg(cg)')} AS overall_consistency_with_gt, "
    f"{r6('avg(CASE WHEN CAST(gt AS VARCHAR) <> ' + chr(39) + '9' + chr(39) + ' THEN cg END)')} "
    f"AS overall_consistency_excl9_with_gt FROM scv", [_PL, _SC, _SCV]))
def q_overall_consistency(spark, sf_dir):
    per = agree.sample_consistency(cross_long(spark, sf_dir), ["sid"], "pred", truth="gt", rounded=False)
    return agree.overall_consistency(per, "gt")


def _hist_sql(col: str) -> str:
    return (f"SELECT '{col}' AS metric, CAST(CASE WHEN hi = lo THEN 0 ELSE "
            f"least(floor((v - lo) / (hi - lo) * 20), 19) END AS INTEGER) AS bin, count(*) AS n "
            f"FROM (SELECT {col} AS v, min({col}) OVER () AS lo, max({col}) OVER () AS hi FROM named "
            f"WHERE {col} IS NOT NULL) GROUP BY ALL")


@register("consistency_histogram", sql=_sql(
    _hist_sql("sample_consistency") + " UNION ALL " + _hist_sql("sample_consistency_with_gt"),
    [_PL, _SC, _SCV, ("named", "SELECT c AS sample_consistency, cg AS sample_consistency_with_gt FROM scv")]))
def q_consistency_histogram(spark, sf_dir):
    per = agree.sample_consistency(cross_long(spark, sf_dir), ["sid"], "pred", truth="gt", rounded=False)
    return agree.consistency_histogram(per, ["sample_consistency", "sample_consistency_with_gt"], 20)


# A8 ---------------------------------------------------------------------------------
def _kappa_sql(by: list[str], src: str, complete: bool) -> str:
    b = "".join(f"{x}, " for x in by)
    part = ", ".join(by + ["sid"])
    using = f"USING ({', '.join(by)})" if by else "ON TRUE"
    gb = f"GROUP BY {', '.join(by)}" if by else ""
    ctes = [
        ("c", f"SELECT {b}sid, pred, count(*) AS c FROM {src} WHERE pred IS NOT NULL GROUP BY ALL"),
        ("cw0", f"SELECT *, sum(c) OVER (PARTITION BY {part}) AS n_i FROM c"),
        ("cw1", "SELECT * FROM cw0 WHERE n_i >= 2"),
    ]
    if complete:
        ctes += [("fullk", f"SELECT {b}max(n_i) AS k FROM cw1 {gb}"),
                 ("cw", f"SELECT cw1.* FROM cw1 JOIN fullk {using} WHERE n_i = k")]
    else:
        ctes += [("cw", "SELECT * FROM cw1")]
    ctes += [
        ("ps", f"SELECT {b}sid, max(n_i) AS n_i, sum(c * c) AS s2 FROM cw GROUP BY ALL"),
        ("st", f"SELECT {b}count(*) AS n_samples, avg((s2 - n_i) / (n_i * (n_i - 1))) AS p_bar, "
               f"min(n_i) AS mn, max(n_i) AS mx, sum(n_i) AS n_votes FROM ps {gb}"),
        ("tt", f"SELECT {b}sum(t * t) AS st2 FROM (SELECT {b}pred, sum(c) AS t FROM cw GROUP BY ALL) {gb}"),
    ]
    body = (f"SELECT {b}{big('n_samples')} AS n_samples, {big('n_votes')} AS n_votes, mn = mx AS equal_votes, "
            f"CASE WHEN mn = mx AND st2 / (n_votes * n_votes) < 1 THEN "
            f"{r6('(p_bar - st2 / (n_votes * n_votes)) / (1 - st2 / (n_votes * n_votes))')} END AS kappa "
            f"FROM st JOIN tt {using}")
    return ctes, body


def _kappa_full(by, src, complete, extra=None):
    ctes, body = _kappa_sql(by, src, complete)
    return _sql(body, (extra or []) + ctes)


@register("fleiss_kappa", sql=_kappa_full(["model"], "pred_long", True),
          note="per model across its runs; samples rated by every run")
def q_fleiss_kappa(spark, sf_dir):
    return agree.fleiss_kappa(Views(spark, sf_dir).pred_long, ["sid"], "pred", by=["model"], complete_only=True)


@register("fleiss_kappa_strict", sql=_kappa_full([], "r", False),
          note="all model-runs as raters; null when vote counts differ (reference rule)")
def q_fleiss_kappa_strict(spark, sf_dir):
    return agree.fleiss_kappa(cross_long(spark, sf_dir), ["sid"], "pred")


# A9 / A10 / A11 ------------------------------------------------------------------------
_PER = ("per", "SELECT model, sid, gt, pred, count(pred) AS n, min(run) AS fr FROM pred_long GROUP BY ALL")
_VOTE = ("v", "SELECT model, sid, gt, arg_max(CASE WHEN n > 0 THEN pred END, n * 1000000 - fr) AS maj, "
              "sum(n) AS tv, max(n) AS top FROM per GROUP BY ALL")


@register("majority_vote", sql=_sql(
    f"SELECT model, sid, gt, maj AS maj_pred, {big('tv')} AS n_votes, "
    f"CASE WHEN tv > 0 THEN {r6('top / tv')} END AS consistency FROM v", [_PER, _VOTE]))
def q_majority_vote(spark, sf_dir):
    return agree.majority_vote(Views(spark, sf_dir).pred_long, ["sid"], "pred", "run", by=["model"], keep=["gt"])


@register("self_consistency", sql=_sql(
    "SELECT s.model, nr.num_runs, s.n_samples, s.self_consistency_incl9, s.self_consistency_excl9, "
    "s.majority_acc_incl9, s.majority_acc_excl9 FROM ("
    f"SELECT model, count(*) AS n_samples, {r6('avg(CASE WHEN tv > 0 THEN top / tv END)')} AS self_consistency_incl9, "
    f"{r6('avg(CASE WHEN gt <> 9 AND tv > 0 THEN top / tv END)')} AS self_consistency_excl9, "
    f"{r6('avg(CASE WHEN gt IS NOT NULL AND maj IS NOT NULL THEN CAST(gt = maj AS DOUBLE) END)')} AS majority_acc_incl9, "
    f"{r6('avg(CASE WHEN gt <> 9 AND gt IS NOT NULL AND maj IS NOT NULL THEN CAST(gt = maj AS DOUBLE) END)')} "
    "AS majority_acc_excl9 FROM v GROUP BY model) s "
    "JOIN (SELECT model, count(DISTINCT run) AS num_runs FROM pred_long GROUP BY model) nr USING (model)",
    [_PER, _VOTE]))
def q_self_consistency(spark, sf_dir):
    return agree.self_consistency(Views(spark, sf_dir).pred_long, ["sid"], "pred", "run", "gt", by=["model"])


@register("run_pairwise", sql=_sql(_pairs_sql(
    "(SELECT sid, model, pred, CAST(run AS VARCHAR) AS rater FROM pred_long)", ["model", "sid"])))
def q_run_pairwise(spark, sf_dir):
    p = Views(spark, sf_dir).pred_long
    return agree.pairwise_agreement(p, ["sid"], "run", "pred", by=["model"], raters=[str(r) for r in RUNS])
