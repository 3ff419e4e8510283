"""Registered classification-metric queries (M1–M8), per prediction file
(= model × run) of ``pred_long``; M7 over the case table."""

from __future__ import annotations

from tallyspark.functions.codes import MANCOLL_CODES, MANCOLL_NAMES
from tallyspark.operators import metrics as M
from tallyspark.plans.registry import register
from tallyspark.plans.sqlkit import big, confusion_cte, f1_expr, per_class_cte, r6, ratio0
from tallyspark.sources.fixtures import Views, with_views

BY = ["model", "run"]


def _preds(spark, sf_dir):
    return Views(spark, sf_dir).pred_long


def _sql(body, extra=None, views="pred_long"):
    return with_views(views, body, extra or [])


_CM = ("cm", confusion_cte("pred_long", "gt", "pred", BY))
_PC = ("pc", per_class_cte("cm", BY))
_CM9 = ("cm9", confusion_cte("(SELECT * FROM pred_long WHERE gt <> 9)", "gt", "pred", BY))
_PC9 = ("pc9", per_class_cte("cm9", BY))


def _acc_f1_sql(cm: str, pc: str) -> str:
    return (f"SELECT a.model, a.run, {big('a.n')} AS n, {r6('a.ok / a.n')} AS accuracy, {r6('f.f1')} AS macro_f1 "
            f"FROM (SELECT model, run, sum(n) AS n, sum(CASE WHEN gt = pred THEN n ELSE 0 END) AS ok "
            f"FROM {cm} GROUP BY ALL) a JOIN (SELECT model, run, avg({f1_expr()}) AS f1 FROM {pc} GROUP BY ALL) f "
            f"USING (model, run)")


@register("accuracy", sql=_sql(
    f"SELECT model, run, count(*) AS n, {r6('avg(CAST(gt = pred AS DOUBLE))')} AS accuracy FROM pred_long "
    "WHERE gt IS NOT NULL AND pred IS NOT NULL GROUP BY ALL"))
def q_accuracy(spark, sf_dir):
    return M.accuracy(_preds(spark, sf_dir), "gt", "pred", BY)


@register("macro_f1", sql=_sql(
    f"SELECT model, run, count(*) AS n_labels, {r6('avg(' + f1_expr() + ')')} AS macro_f1 FROM pc GROUP BY ALL",
    [_CM, _PC]))
def q_macro_f1(spark, sf_dir):
    return M.macro_f1(_preds(spark, sf_dir), "gt", "pred", BY)


@register("metrics_excl_class", sql=_sql(_acc_f1_sql("cm9", "pc9"), [_CM9, _PC9]))
def q_metrics_excl_class(spark, sf_dir):
    return M.metrics_excl_class(_preds(spark, sf_dir), "gt", "pred", BY)


def _names_case(col: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MANCOLL_NAMES.items())
    return f"CASE {col} {whens} ELSE {col} END"


_CR_ROWS = ("crr", f"SELECT model, run, CAST(label AS VARCHAR) AS row, {ratio0('tp', 'tp + fp')} AS precision, "
                   f"{ratio0('tp', 'tp + fn')} AS recall, {f1_expr()} AS f1, tp, support FROM pc")
_CR_TOT = ("crt", "SELECT model, run, sum(tp) AS tp, sum(support) AS s, avg(precision) AS mp, avg(recall) AS mr, "
                  "avg(f1) AS mf, sum(precision * support) AS wp, sum(recall * support) AS wr, "
                  "sum(f1 * support) AS wf FROM crr GROUP BY ALL")


@register("class_report", sql=_sql(
    "SELECT model, run, row, " + r6("precision") + " AS precision, " + r6("recall") + " AS recall, "
    + r6("f1") + " AS f1, " + big("support") + " AS support, " + _names_case("row") + " AS name FROM ("
    "SELECT model, run, row, precision, recall, f1, support FROM crr "
    f"UNION ALL SELECT model, run, 'accuracy', NULL, NULL, {ratio0('tp', 's')}, s FROM crt "
    "UNION ALL SELECT model, run, 'macro avg', mp, mr, mf, s FROM crt "
    f"UNION ALL SELECT model, run, 'weighted avg', {ratio0('wp', 's')}, {ratio0('wr', 's')}, {ratio0('wf', 's')}, s "
    "FROM crt)", [_CM, _PC, _CR_ROWS, _CR_TOT]))
def q_class_report(spark, sf_dir):
    return M.class_report(_preds(spark, sf_dir), "gt", "pred", BY, names=MANCOLL_NAMES)


_LABELS = ", ".join(str(c) for c in MANCOLL_CODES)


@register("confusion_matrix", sql=_sql(
    f"SELECT g.model, g.run, g.gt, g.pred, {big('coalesce(c.n, 0)')} AS n, "
    f"{r6(ratio0('coalesce(c.n, 0)', 'sum(coalesce(c.n, 0)) OVER (PARTITION BY g.model, g.run, g.gt)'))} AS share "
    f"FROM (SELECT DISTINCT model, run FROM cmf) grp "
    f"JOIN (SELECT grp2.model, grp2.run, a.gt, b.pred FROM (SELECT DISTINCT model, run FROM cmf) grp2, "
    f"(SELECT unnest([{_LABELS}]) AS gt) a, (SELECT unnest([{_LABELS}]) AS pred) b) g "
    f"ON g.model = grp.model AND g.run = grp.run "
    f"LEFT JOIN cmf c ON c.model = g.model AND c.run = g.run AND c.gt = g.gt AND c.pred = g.pred",
    [_CM, ("cmf", f"SELECT * FROM cm WHERE gt IN ({_LABELS}) AND pred IN ({_LABELS})")]))
def q_confusion_matrix(spark, sf_dir):
    return M.confusion_matrix(_preds(spark, sf_dir), "gt", "pred", MANCOLL_CODES, BY)


@register("class_subset_dist", sql=_sql(
    f"SELECT s.model, s.run, {big('s.n_total')} AS n_total, {big('s.n_subset')} AS n_subset, "
    f"{r6(ratio0('s.n_subset', 's.n_total'))} AS subset_share, c.code AS pred_code, "
    f"{big('coalesce(d.k, 0)')} AS n_pred_code, {r6(ratio0('coalesce(d.k, 0)', 's.n_pred'))} AS pred_share "
    "FROM (SELECT model, run, count(*) AS n_total, count(CASE WHEN gt = 9 THEN 1 END) AS n_subset, "
    "count(CASE WHEN gt = 9 AND pred IS NOT NULL THEN 1 END) AS n_pred FROM pred_long GROUP BY ALL) s "
    f"CROSS JOIN (SELECT unnest([{_LABELS}]) AS code) c "
    "LEFT JOIN (SELECT model, run, pred, count(*) AS k FROM pred_long WHERE gt = 9 GROUP BY ALL) d "
    "ON d.model = s.model AND d.run = s.run AND d.pred = c.code"))
def q_class_subset_dist(spark, sf_dir):
    return M.class_subset_dist(_preds(spark, sf_dir), "gt", "pred", 9, MANCOLL_CODES, BY)


_NAMES_VALUES = ", ".join(f"({k}, '{v}')" for k, v in MANCOLL_NAMES.items())


@register("label_share", sql=with_views("cases", (
    f"SELECT c.code, c.name, {big('coalesce(d.k, 0)')} AS n, {r6(ratio0('coalesce(d.k, 0)', 't.nn'))} AS share, "
    f"format('{{:.1f}}%', round({ratio0('coalesce(d.k, 0)', 't.nn')} * 100, 1)) AS pct_text, "
    f"{ratio0('coalesce(d.k, 0)', 't.nn')} >= 0.01 AS labelled "
    f"FROM (VALUES {_NAMES_VALUES}) c(code, name) CROSS JOIN (SELECT count(mancoll) AS nn FROM cases) t "
    "LEFT JOIN (SELECT mancoll, count(*) AS k FROM cases GROUP BY ALL) d ON d.mancoll = c.code")))
def q_label_share(spark, sf_dir):
    return M.label_share(Views(spark, sf_dir).cases, "mancoll", names=MANCOLL_NAMES)


@register("metrics_table", sql=_sql(
    "SELECT model, run, 'overall' AS scope, 'accuracy' AS metric, accuracy AS value FROM o "
    "UNION ALL SELECT model, run, 'overall', 'macro_f1', macro_f1 FROM o "
    "UNION ALL SELECT model, run, 'excl_9', 'accuracy', accuracy FROM x "
    "UNION ALL SELECT model, run, 'excl_9', 'macro_f1', macro_f1 FROM x",
    [_CM, _PC, _CM9, _PC9, ("o", _acc_f1_sql("cm", "pc")), ("x", _acc_f1_sql("cm9", "pc9"))]))
def q_metrics_table(spark, sf_dir):
    return M.metrics_table(_preds(spark, sf_dir), "gt", "pred", BY)
