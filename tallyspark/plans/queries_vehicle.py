"""Registered vehicle-scoring queries (V1–V10) over ``gv`` (truth) and ``vpred``."""

from __future__ import annotations

from tallyspark.operators import vehicle as VH
from tallyspark.plans.registry import register
from tallyspark.plans.sqlkit import big, confusion_cte, f1_expr, per_class_cte, r6, ratio0
from tallyspark.sources.fixtures import Views, with_views

_VALS = ("crashcat", "crashconf", "crashtype")
_K = ("k", "SELECT coalesce(t.caseid, p.caseid) AS caseid, coalesce(t.vehno, p.vehno) AS vehno, "
           "t.caseid IS NOT NULL AS in_truth, p.caseid IS NOT NULL AS in_pred, "
           + ", ".join(f"t.{v} AS t_{v}, p.{v} AS p_{v}" for v in _VALS)
           + " FROM gv t FULL OUTER JOIN vp1 p ON t.caseid = p.caseid AND t.vehno = p.vehno")
_F = ("f", "SELECT *, in_truth AND in_pred AS matched, "
           "in_truth AND in_pred AND coalesce(t_crashcat, -1) = coalesce(p_crashcat, -1) AS cat_ok, "
           "in_truth AND in_pred AND coalesce(t_crashconf = p_crashconf, false) AS conf_ok, "
           "in_truth AND in_pred AND coalesce(t_crashtype, -1) = coalesce(p_crashtype, -1) AS type_ok FROM k")
_F2 = ("f2", "SELECT *, cat_ok AND conf_ok AND type_ok AS exact_ok FROM f")


def _sql(body, extra=None, views=("gv", "vp1")):
    return with_views(list(views), body, [_K, _F, _F2] + (extra or []))


def _eval_sql(exact: str) -> str:
    g = ("SELECT caseid, sum(in_truth::INT) AS n_truth, sum(in_pred::INT) AS n_pred, sum(matched::INT) AS matched, "
         f"sum(cat_ok::INT) AS c, sum(conf_ok::INT) AS cf, sum(type_ok::INT) AS ty, sum({exact}::INT) AS ex "
         "FROM f2 GROUP BY caseid")
    pr = (f"SELECT *, {ratio0('ex', 'n_pred')} AS pp, {ratio0('ex', 'n_truth')} AS rr FROM ({g})")
    return (f"SELECT caseid, {big('n_truth')} AS n_truth, {big('n_pred')} AS n_pred, {big('matched')} AS matched, "
            f"{r6(ratio0('c', 'matched'))} AS cat_acc, {r6(ratio0('cf', 'matched'))} AS conf_acc, "
            f"{r6(ratio0('ty', 'matched'))} AS type_acc, {r6(ratio0('ex', 'matched'))} AS exact_acc, "
            f"{r6('pp')} AS precision, {r6('rr')} AS recall, "
            f"{r6('CASE WHEN pp + rr > 0 THEN 2 * pp * rr / (pp + rr) ELSE 0.0 END')} AS f1 FROM ({pr})")


def _tp(spark, sf_dir):
    v = Views(spark, sf_dir)
    return v.gv, v.vpred


for _mode, _key, _exact in (("cat", "vehicle_eval_cat", "cat_ok"), ("conf", "vehicle_eval_conf", "conf_ok"),
                            ("type", "vehicle_eval_type", "exact_ok")):
    def _q(spark, sf_dir, _m=_mode):
        t, p = _tp(spark, sf_dir)
        return VH.vehicle_eval(t, p, _m)
    register(_key, sql=_sql(_eval_sql(_exact)))(_q)


@register("vehicle_correctness", sql=_sql("SELECT * FROM f2"))
def q_vehicle_correctness(spark, sf_dir):
    return VH.vehicle_correctness(*_tp(spark, sf_dir))


@register("missed_vehicles", sql=with_views(["gv", "vp1"],
    "SELECT caseid, vehno FROM gv ANTI JOIN vp1 USING (caseid, vehno)"))
def q_missed_vehicles(spark, sf_dir):
    return VH.missed_vehicles(*_tp(spark, sf_dir))


@register("extra_predictions", sql=with_views(["gv", "vp1"],
    "SELECT caseid, vehno FROM vp1 ANTI JOIN gv USING (caseid, vehno)"))
def q_extra_predictions(spark, sf_dir):
    return VH.extra_predictions(*_tp(spark, sf_dir))


def _txt(src: str) -> str:
    def s(c):
        return f"coalesce(CAST({c} AS VARCHAR), 'nan')"
    return (f"SELECT caseid, row_number() OVER (PARTITION BY caseid ORDER BY vehno) AS pos, "
            f"'(' || concat_ws(', ', CAST(caseid AS VARCHAR), CAST(vehno AS VARCHAR), {s('crashcat')}, "
            f"{s('crashconf')}, {s('crashtype')}) || ')' AS txt FROM {src}")


@register("gt_pred_lines", sql=with_views(["gv", "vp1"],
    "SELECT coalesce(a.caseid, b.caseid) AS caseid, coalesce(a.pos, b.pos) AS pos, a.txt AS truth_text, "
    "b.txt AS pred_text, coalesce(a.txt, '-') || ' → ' || coalesce(b.txt, '-') AS line "
    "FROM tp a FULL OUTER JOIN pp b ON a.caseid = b.caseid AND a.pos = b.pos",
    [("tp", _txt("gv")), ("pp", _txt("vp1"))]))
def q_gt_pred_lines(spark, sf_dir):
    return VH.gt_pred_lines(*_tp(spark, sf_dir))


@register("case_accuracy", sql=with_views(["gv", "vp1", "cases_dup"],
    f"SELECT h.caseid, c.vehicles, c.summary, "
    f"{r6('CASE WHEN c.vehicles > 0 THEN h.correct / c.vehicles ELSE 0.0 END')} AS case_accuracy "
    "FROM (SELECT t.caseid, count(*) FILTER (WHERE t.crashtype = p.crashtype) AS correct "
    "FROM gv t LEFT JOIN vp1 p USING (caseid, vehno) GROUP BY t.caseid) h JOIN (SELECT * FROM cases_dup "
    "QUALIFY row_number() OVER (PARTITION BY caseid ORDER BY vehicles, summary) = 1) c USING (caseid)"))
def q_case_accuracy(spark, sf_dir):
    v = Views(spark, sf_dir)
    return VH.case_accuracy(v.cases_dup, v.gv, v.vpred)


_J = ("j", "SELECT t.crashtype AS gt, p.crashtype AS pred FROM gv t JOIN vp1 p USING (caseid, vehno)")


@register("vehicle_overall", sql=with_views(["gv", "vp1"],
    f"SELECT {big('a.n')} AS n, {r6('a.ok / a.n')} AS accuracy, {r6('f.f1')} AS macro_f1 FROM "
    "(SELECT sum(n) AS n, sum(CASE WHEN gt = pred THEN n ELSE 0 END) AS ok FROM cm) a, "
    f"(SELECT avg({f1_expr()}) AS f1 FROM pc) f",
    [_J, ("cm", confusion_cte("j", "gt", "pred", [])), ("pc", per_class_cte("cm", []))]))
def q_vehicle_overall(spark, sf_dir):
    return VH.vehicle_overall(*_tp(spark, sf_dir))


@register("case_report", sql=_sql(
    "SELECT e.caseid, c.summary, e.n_truth, e.n_pred, e.matched, e.cat_acc, e.conf_acc, e.type_acc, "
    "e.exact_acc, e.recall, e.precision, e.f1, e.n_truth - e.matched AS n_missed, e.n_pred - e.matched AS n_extra "
    "FROM ev e LEFT JOIN (SELECT caseid, min(summary) AS summary FROM cases_dup GROUP BY caseid) c USING (caseid)", [("ev", _eval_sql("exact_ok"))],
    views=("gv", "vp1", "cases_dup")))
def q_case_report(spark, sf_dir):
    v = Views(spark, sf_dir)
    return VH.case_report(v.cases_dup, v.gv, v.vpred)


def _side_sql(side: str, present: str) -> str:
    parts = ", ".join(f"coalesce(CAST({side}_{v} AS VARCHAR), 'nan')" for v in _VALS)
    return f"CASE WHEN {present} THEN '(' || concat_ws(', ', CAST(caseid AS VARCHAR), CAST(vehno AS VARCHAR), {parts}) || ')' END"


@register("case_report_detail", sql=_sql(
    "SELECT caseid, vehno, CASE WHEN in_truth AND in_pred THEN 'matched' WHEN in_truth THEN 'missed' ELSE 'extra' END "
    f"AS status, {_side_sql('t', 'in_truth')} AS truth_text, {_side_sql('p', 'in_pred')} AS pred_text FROM k"))
def q_case_report_detail(spark, sf_dir):
    return VH.case_report_detail(*_tp(spark, sf_dir))
