"""Vehicle-level scoring.

Truth and prediction rows are keyed by (case, vehicle).  Instead of a full
outer join, both sides are tagged and unioned; one aggregate per key pairs
them, and a per-case aggregate (combined map-side before its shuffle)
scores each case.  A case holding a third of all vehicles is therefore
spread over all tasks by (case, vehicle) and reaches the per-case step as
one partial row per task; no group is ever materialised as a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.ranking import row_number_within
from tallyspark.operators.relate import first_per_key

VALUES = ("crashcat", "crashconf", "crashtype")
MODES = ("cat", "conf", "type")


def _r6(c: Column) -> Column:
    return F.round(c, 6)


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def pair_vehicles(truth: DataFrame, pred: DataFrame, case: str = "caseid", veh: str = "vehno",
                  values: tuple[str, ...] = VALUES, order: tuple[str, ...] = ()) -> DataFrame:
    """One row per key in truth ∪ prediction with both sides' values.

    Columns: case, veh, in_truth, in_pred, t_<v>, p_<v> for each value.  A
    key that one side repeats counts with its first row: the smallest by
    ``order`` (columns of that side, if it has them) and then by the values,
    null first.  The row is taken as a whole, so values of two rows never mix.
    """
    cols = [case, veh, *values]

    def side(df: DataFrame) -> Column:
        return F.struct(*[F.col(c) for c in order if c in df.columns], *[F.col(v) for v in values])
    t = truth.select(case, veh, side(truth).alias("_tr"))
    p = pred.select(case, veh, side(pred).alias("_pr"))
    # One aggregate for both sides; the least whole row keeps its values together.
    both = t.unionByName(p, allowMissingColumns=True)
    g = both.groupBy(case, veh).agg(F.min("_tr").alias("_tr"), F.min("_pr").alias("_pr"))
    return g.select(case, veh, F.col("_tr").isNotNull().alias("in_truth"), F.col("_pr").isNotNull().alias("in_pred"),
                    *[F.col(f"_tr.{v}").alias(f"t_{v}") for v in values],
                    *[F.col(f"_pr.{v}").alias(f"p_{v}") for v in values])


def correctness_flags(pairs: DataFrame) -> DataFrame:
    """V4 flags: category and type compare with null read as -1; the
    configuration letter compares as is (null never equal)."""
    both = F.col("in_truth") & F.col("in_pred")
    cat_ok = both & (F.coalesce("t_crashcat", F.lit(-1)) == F.coalesce("p_crashcat", F.lit(-1)))
    conf_ok = both & F.coalesce(F.col("t_crashconf") == F.col("p_crashconf"), F.lit(False))
    type_ok = both & (F.coalesce("t_crashtype", F.lit(-1)) == F.coalesce("p_crashtype", F.lit(-1)))
    return pairs.select("*", both.alias("matched"), cat_ok.alias("cat_ok"), conf_ok.alias("conf_ok"),
                        type_ok.alias("type_ok"), (cat_ok & conf_ok & type_ok).alias("exact_ok"))


def vehicle_correctness(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """V4: row per key in truth ∪ prediction with the four flags and both tuples."""
    return correctness_flags(pair_vehicles(truth, pred))


def vehicle_eval(truth: DataFrame, pred: DataFrame, mode: str = "type", case: str = "caseid") -> DataFrame:
    """V1/V2/V3: per-case counts, accuracies over matched keys and
    exact-match precision/recall/F1.

    "Exact" is the category (``cat``), the configuration (``conf``), or all
    three labels (``type``).  Ratios with a zero denominator are 0.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    f = correctness_flags(pair_vehicles(truth, pred, case))
    exact = {"cat": "cat_ok", "conf": "conf_ok", "type": "exact_ok"}[mode]

    def n(c):
        return F.sum(F.col(c).cast("int"))

    g = f.groupBy(case).agg(n("in_truth").alias("n_truth"), n("in_pred").alias("n_pred"),
                            n("matched").alias("matched"), n("cat_ok").alias("_cat"),
                            n("conf_ok").alias("_conf"), n("type_ok").alias("_type"), n(exact).alias("_exact"))
    m = F.col("matched")
    prec = _ratio(F.col("_exact"), F.col("n_pred"))
    rec = _ratio(F.col("_exact"), F.col("n_truth"))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return g.select(case, *[F.col(c).cast("bigint").alias(c) for c in ("n_truth", "n_pred", "matched")],
                    _r6(_ratio(F.col("_cat"), m)).alias("cat_acc"),
                    _r6(_ratio(F.col("_conf"), m)).alias("conf_acc"),
                    _r6(_ratio(F.col("_type"), m)).alias("type_acc"),
                    _r6(_ratio(F.col("_exact"), m)).alias("exact_acc"),
                    _r6(prec).alias("precision"), _r6(rec).alias("recall"), _r6(f1).alias("f1"))


def missed_vehicles(truth: DataFrame, pred: DataFrame, keys=("caseid", "vehno")) -> DataFrame:
    """V5: truth keys with no prediction."""
    return truth.select(*keys).distinct().join(pred.select(*keys), list(keys), "left_anti")


def extra_predictions(truth: DataFrame, pred: DataFrame, keys=("caseid", "vehno")) -> DataFrame:
    """V6: predicted keys that are not in the truth."""
    return pred.select(*keys).distinct().join(truth.select(*keys), list(keys), "left_anti")


def vehicle_text(prefix: str) -> Column:
    def s(c):
        return F.coalesce(F.col(f"{prefix}{c}").cast("string"), F.lit("nan"))
    return F.concat(F.lit("("), F.concat_ws(", ", F.col("caseid").cast("string"), F.col("vehno").cast("string"),
                                            s("crashcat"), s("crashconf"), s("crashtype")), F.lit(")"))


def gt_pred_lines(truth: DataFrame, pred: DataFrame, case: str = "caseid") -> DataFrame:
    """V7: truth and prediction vehicles of a case paired **by position**
    (vehicle order), ``-`` where one side is shorter; one row per line.

    Lines stay rows (no per-case string), so a huge case is never one value;
    positions come from :func:`row_number_within`, so it is not one task either.
    """
    def side(df, tag):
        df = first_per_key(df, [case, "vehno"], [], list(VALUES))
        rows = df.select(case, "vehno", vehicle_text("").alias("txt"))
        return row_number_within(rows, [case], ["vehno"], "pos").select(
            case, "pos", "txt", F.lit(tag).alias("_side"))
    u = side(truth, "t").unionByName(side(pred, "p"))
    g = u.groupBy(case, "pos").agg(F.max(F.when(F.col("_side") == "t", F.col("txt"))).alias("truth_text"),
                                   F.max(F.when(F.col("_side") == "p", F.col("txt"))).alias("pred_text"))
    line = F.concat(F.coalesce("truth_text", F.lit("-")), F.lit(" → "), F.coalesce("pred_text", F.lit("-")))
    return g.select(case, "pos", "truth_text", "pred_text", line.alias("line"))


def case_accuracy(cases: DataFrame, truth: DataFrame, pred: DataFrame,
                  label: str = "crashtype", case: str = "caseid", case_order: tuple[str, ...] = ()) -> DataFrame:
    """V8: per case, correct vehicles ÷ VEHICLES of the case row (0 when
    VEHICLES ≤ 0).

    Every case with a truth row is scored: a vehicle without a truth label or a
    prediction counts as not correct.  Cases without a case row are dropped; of
    several case rows the first by ``case_order`` counts.
    """
    pairs = pair_vehicles(truth, pred, case).where("in_truth")
    right = F.coalesce(F.col(f"t_{label}") == F.col(f"p_{label}"), F.lit(False))
    hit = pairs.groupBy(case).agg(F.count_if(right).alias("_correct"))
    c = first_per_key(cases, [case], list(case_order), ["vehicles", "summary"])
    acc = F.when(F.col("vehicles") > 0, F.col("_correct") / F.col("vehicles")).otherwise(F.lit(0.0))
    return hit.join(c, case).select(case, "vehicles", "summary", _r6(acc).alias("case_accuracy"))


def vehicle_overall(truth: DataFrame, pred: DataFrame, label: str = "crashtype") -> DataFrame:
    """V9: accuracy and macro-F1 of the label over matched vehicles."""
    from tallyspark.operators.metrics import accuracy_and_f1
    j = pair_vehicles(truth, pred).where("in_truth and in_pred")
    return accuracy_and_f1(j.select(F.col(f"t_{label}").alias("gt"), F.col(f"p_{label}").alias("pred")), "gt", "pred")


def case_report(cases: DataFrame, truth: DataFrame, pred: DataFrame, mode: str = "type",
                case: str = "caseid", case_order: tuple[str, ...] = ()) -> DataFrame:
    """One row per scored case: narrative (first case row by
    ``case_order``), the metrics side by side and the number of missed and extra
    vehicles; :func:`case_report_detail` lists them."""
    ev = vehicle_eval(truth, pred, mode, case)
    c = first_per_key(cases, [case], list(case_order), ["summary"])
    return (ev.join(c, case, "left")
            .select(case, "summary", "n_truth", "n_pred", "matched", "cat_acc", "conf_acc", "type_acc",
                    "exact_acc", "recall", "precision", "f1",
                    (F.col("n_truth") - F.col("matched")).alias("n_missed"),
                    (F.col("n_pred") - F.col("matched")).alias("n_extra")))


def case_report_detail(truth: DataFrame, pred: DataFrame, case: str = "caseid", veh: str = "vehno") -> DataFrame:
    """V10's details as rows: every vehicle of a case with its status (matched,
    missed, extra) and both sides as text, so a huge case is never one value."""
    pairs = pair_vehicles(truth, pred, case, veh)
    status = (F.when(F.col("in_truth") & F.col("in_pred"), "matched").when(F.col("in_truth"), "missed")
              .otherwise("extra"))

    def said(side: str, present: str) -> Column:
        parts = [F.coalesce(F.col(f"{side}_{v}").cast("string"), F.lit("nan")) for v in VALUES]
        return F.when(F.col(present), F.concat(F.lit("("), F.concat_ws(
            ", ", F.col(case).cast("string"), F.col(veh).cast("string"), *parts), F.lit(")")))
    return pairs.select(case, veh, status.alias("status"), said("t", "in_truth").alias("truth_text"),
                        said("p", "in_pred").alias("pred_text"))
