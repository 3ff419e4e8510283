"""Classification metrics as aggregations (M1–M8).

All metrics derive from one confusion-count table ``(by..., gt, pred, n)``:
a hash aggregate with map-side combine, whose size is groups × classes², so
every step after the first is tiny regardless of the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyspark.functions.codes import MANCOLL_NAMES, UNKNOWN_CODE
from tallyspark.functions.joins import join_keys


def _r6(c: Column) -> Column:
    return F.round(c, 6)


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def confusion_counts(df: DataFrame, gt: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """(by..., gt, pred, n) over rows where both sides are present."""
    by = by or []
    return (df.where(F.col(gt).isNotNull() & F.col(pred).isNotNull())
            .groupBy(*by, F.col(gt).alias("gt"), F.col(pred).alias("pred"))
            .agg(F.count(F.lit(1)).alias("n")))


def per_class_counts(cm: DataFrame, by: list[str]) -> DataFrame:
    """(by..., label, tp, fp, fn, support) over labels seen in truth ∪ prediction."""
    same = F.col("gt") == F.col("pred")
    sides = F.array(
        F.struct(F.col("gt").alias("label"), F.when(same, F.col("n")).otherwise(0).alias("tp"),
                 F.lit(0).cast("bigint").alias("fp"), F.when(same, 0).otherwise(F.col("n")).alias("fn"),
                 F.col("n").alias("support")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("bigint").alias("tp"),
                 F.when(same, 0).otherwise(F.col("n")).alias("fp"), F.lit(0).cast("bigint").alias("fn"),
                 F.lit(0).cast("bigint").alias("support")))
    return (cm.select(*by, F.inline(sides)).groupBy(*by, "label")
            .agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
                 F.sum("support").alias("support")))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return _ratio(2 * tp, 2 * tp + fp + fn)


def accuracy(df: DataFrame, gt: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """M1: share of rows with gt = pred; rows null on either side are ignored."""
    by = by or []
    ok = F.col(gt).isNotNull() & F.col(pred).isNotNull()
    return (df.where(ok).groupBy(*by)
            .agg(F.count(F.lit(1)).alias("n"),
                 _r6(F.avg((F.col(gt) == F.col(pred)).cast("double"))).alias("accuracy")))


def macro_f1(df: DataFrame, gt: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """M2: mean per-class F1 over labels in truth ∪ prediction (undefined F1 = 0)."""
    by = by or []
    pc = per_class_counts(confusion_counts(df, gt, pred, by), by)
    return pc.groupBy(*by).agg(F.count(F.lit(1)).alias("n_labels"),
                               _r6(F.avg(_f1(F.col("tp"), F.col("fp"), F.col("fn")))).alias("macro_f1"))


def scores(confusion: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy and macro-F1 per ``by`` group from a confusion table.  Per-class
    counts hold all of it: every row supports one class, every hit is one true
    positive."""
    pc = per_class_counts(confusion, by)
    hit = F.sum("tp") / F.sum("support")
    return pc.groupBy(*by).agg(F.sum("support").cast("bigint").alias("n"), _r6(hit).alias("accuracy"),
                               _r6(F.avg(_f1(F.col("tp"), F.col("fp"), F.col("fn")))).alias("macro_f1"))


def accuracy_and_f1(df: DataFrame, gt: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """M1 + M2 from one confusion table."""
    by = by or []
    return scores(confusion_counts(df, gt, pred, by), by)


def metrics_excl_class(df: DataFrame, gt: str, pred: str, by: list[str] | None = None,
                       exclude=UNKNOWN_CODE) -> DataFrame:
    """M3: M1 + M2 after removing rows whose *truth* is ``exclude``.

    Predictions of the excluded class stay, so it still adds a zero-F1 class.
    """
    return accuracy_and_f1(df.where(F.col(gt) != F.lit(exclude)), gt, pred, by)


def class_report(df: DataFrame, gt: str, pred: str, by: list[str] | None = None,
                 names: dict | None = None) -> DataFrame:
    """M4: per-class precision/recall/F1/support + accuracy, macro and weighted rows."""
    by = by or []
    pc = per_class_counts(confusion_counts(df, gt, pred, by), by)
    p = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f = _f1(F.col("tp"), F.col("fp"), F.col("fn"))
    rows = pc.select(*by, F.col("label").cast("string").alias("row"), p.alias("precision"),
                     r.alias("recall"), f.alias("f1"), F.col("tp"), F.col("support"))
    tot = rows.groupBy(*by).agg(
        F.sum("tp").alias("_tp"), F.sum("support").alias("_s"),
        F.avg("precision").alias("_mp"), F.avg("recall").alias("_mr"), F.avg("f1").alias("_mf"),
        F.sum(F.col("precision") * F.col("support")).alias("_wp"),
        F.sum(F.col("recall") * F.col("support")).alias("_wr"),
        F.sum(F.col("f1") * F.col("support")).alias("_wf"))
    s = F.col("_s")
    summary = tot.select(*by, F.inline(F.array(
        F.struct(F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), _ratio(F.col("_tp"), s).alias("f1"),
                 s.alias("support")),
        F.struct(F.lit("macro avg").alias("row"), F.col("_mp").alias("precision"), F.col("_mr").alias("recall"),
                 F.col("_mf").alias("f1"), s.alias("support")),
        F.struct(F.lit("weighted avg").alias("row"), _ratio(F.col("_wp"), s).alias("precision"),
                 _ratio(F.col("_wr"), s).alias("recall"), _ratio(F.col("_wf"), s).alias("f1"),
                 s.alias("support")))))
    out = rows.drop("tp").unionByName(summary)
    out = out.select(*by, "row", *[_r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")],
                     F.col("support").cast("bigint").alias("support"))
    if names:
        nm = F.create_map(*[x for k, v in names.items() for x in (F.lit(str(k)), F.lit(v))])
        out = out.withColumn("name", F.coalesce(F.try_element_at(nm, F.col("row")), F.col("row")))
    return out


def confusion_matrix(df: DataFrame, gt: str, pred: str, labels: list, by: list[str] | None = None) -> DataFrame:
    """M5: counts over a fixed label grid, row-normalised ('true').

    Pairs outside ``labels`` are ignored; an empty truth row gives 0.  The
    grid is generated per group from the group list (a Generate, no join
    of all pairs), then left-joined to the counts.
    """
    by = by or []
    lab = [F.lit(x) for x in labels]
    cm = confusion_counts(df, gt, pred, by).where(F.col("gt").isin(labels) & F.col("pred").isin(labels))
    groups = cm.select(*by).distinct() if by else cm.sparkSession.range(1).select()
    grid_cells = F.array(*[F.struct(a.alias("gt"), b.alias("pred")) for a in lab for b in lab])
    grid = groups.select(*by, F.inline(grid_cells))
    j = join_keys(grid, cm, by + ["gt", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
    row_total = F.sum("n").over(Window.partitionBy(*by, "gt"))
    return j.select(*by, "gt", "pred", "n", _r6(_ratio(F.col("n"), row_total)).alias("share"))


def class_subset_dist(df: DataFrame, gt: str, pred: str, cls, codes: list, by: list[str] | None = None) -> DataFrame:
    """M6: rows whose truth is ``cls``: count, share of all rows, and the
    distribution of their predictions over ``codes`` (0-filled).

    The distribution's denominator is the subset's non-null predictions,
    including codes outside the list.
    """
    by = by or []
    is_c = F.col(gt) == F.lit(cls)
    stats = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_total"), F.count(F.when(is_c, 1)).alias("n_subset"),
        F.count(F.when(is_c & F.col(pred).isNotNull(), 1)).alias("_n_pred"),
        *[F.count(F.when(is_c & (F.col(pred) == F.lit(c)), 1)).alias(f"_c{i}") for i, c in enumerate(codes)])
    cells = F.array(*[F.struct(F.lit(c).alias("pred_code"), F.col(f"_c{i}").alias("n_pred_code"))
                      for i, c in enumerate(codes)])
    return stats.select(*by, F.col("n_total").cast("bigint").alias("n_total"),
                        F.col("n_subset").cast("bigint").alias("n_subset"),
                        _r6(_ratio(F.col("n_subset"), F.col("n_total"))).alias("subset_share"),
                        "_n_pred", F.inline(cells)).select(
        *by, "n_total", "n_subset", "subset_share", "pred_code",
        F.col("n_pred_code").cast("bigint").alias("n_pred_code"),
        _r6(_ratio(F.col("n_pred_code"), F.col("_n_pred"))).alias("pred_share"))


def label_share(df: DataFrame, col: str, by: list[str] | None = None, names: dict | None = None,
                threshold: float = 0.01) -> DataFrame:
    """M7: share of each code over a fixed list with 0 fill, its name, a
    one-decimal percent text and whether it is labelled (share ≥ 1 %)."""
    by = by or []
    names = names or MANCOLL_NAMES
    codes = list(names)
    stats = df.groupBy(*by).agg(
        F.count(F.col(col)).alias("_nn"),
        *[F.count(F.when(F.col(col) == F.lit(c), 1)).alias(f"_c{i}") for i, c in enumerate(codes)])
    cells = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(names[c]).alias("name"),
                               F.col(f"_c{i}").alias("n")) for i, c in enumerate(codes)])
    t = stats.select(*by, "_nn", F.inline(cells))
    share = _ratio(F.col("n"), F.col("_nn"))
    return t.select(*by, "code", "name", F.col("n").cast("bigint").alias("n"), _r6(share).alias("share"),
                    F.format_string("%.1f%%", F.round(share * 100, 1)).alias("pct_text"),
                    (share >= threshold).alias("labelled"))


def metrics_table(df: DataFrame, gt: str, pred: str, by: list[str] | None = None,
                  exclude=UNKNOWN_CODE) -> DataFrame:
    """M8: overall and excluding-``exclude`` accuracy and macro-F1, long form."""
    by = by or []
    cm = confusion_counts(df, gt, pred, by)
    outside = F.col("gt") != F.lit(exclude)
    scopes = F.when(outside, F.array(F.lit("overall"), F.lit(f"excl_{exclude}"))).otherwise(F.array(F.lit("overall")))
    m = scores(cm.withColumn("scope", F.explode(scopes)), [*by, "scope"])
    return m.select(*by, "scope", F.inline(F.array(
        F.struct(F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value")),
        F.struct(F.lit("macro_f1").alias("metric"), F.col("macro_f1").alias("value")))))


__all__ = ["accuracy", "macro_f1", "accuracy_and_f1", "metrics_excl_class", "class_report",
           "confusion_matrix", "class_subset_dist", "label_share", "metrics_table",
           "confusion_counts", "per_class_counts"]
