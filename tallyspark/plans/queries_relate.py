"""Registered relational-preparation queries."""

from __future__ import annotations

from tallyspark.functions.codes import CRASHCAT_NAMES
from tallyspark.operators import relate as R
from tallyspark.plans.queries_text import CONF_CO, CONF_OPTIONS_SQL, _focus_sql, category_letters
from tallyspark.plans.registry import register
from tallyspark.sources.fixtures import GV_ORDER, Views, with_views

_EXC = ("ex", "SELECT caseid, summary, vehicles, mancoll, CAST(unnest(generate_series(1, vehicles)) AS INTEGER) "
              "AS vehno FROM cases WHERE vehicles >= 1")
_FIRST = ("ft", "SELECT caseid, vehno, crashcat, crashconf, crashtype FROM (SELECT *, row_number() OVER ("
                f"PARTITION BY caseid, vehno ORDER BY {', '.join(GV_ORDER)}, crashcat, crashconf, crashtype) AS rn_ "
                "FROM gv_raw) WHERE rn_ = 1")


def cases_exploded(spark, sf_dir):
    return R.explode_vehicles(Views(spark, sf_dir).cases)


@register("explode_vehicles", sql=with_views("cases", "SELECT * FROM ex", [_EXC]))
def q_explode_vehicles(spark, sf_dir):
    return cases_exploded(spark, sf_dir)


def lookup(spark, sf_dir, key_cast=None):
    v = Views(spark, sf_dir)
    ex = cases_exploded(spark, sf_dir).select("caseid", "vehno", "vehicles")
    return R.lookup_truth(ex, v.gv_raw, order=GV_ORDER, key_cast=key_cast)


@register("lookup_truth", sql=with_views(["cases", "gv_raw"],
    "SELECT ex.caseid, ex.vehno, ex.vehicles, ft.crashcat, ft.crashconf, ft.crashtype "
    "FROM ex LEFT JOIN ft USING (caseid, vehno)", [_EXC, _FIRST]))
def q_lookup_truth(spark, sf_dir):
    return lookup(spark, sf_dir).select("caseid", "vehno", "vehicles", "crashcat", "crashconf", "crashtype")


@register("lookup_truth_text_key", sql=with_views(["cases", "gv_raw"],
    "SELECT CAST(ex.caseid AS VARCHAR) AS caseid, CAST(ex.vehno AS VARCHAR) AS vehno, ex.vehicles, "
    "ft.crashcat, ft.crashconf, ft.crashtype FROM ex LEFT JOIN ft "
    "ON CAST(ex.caseid AS VARCHAR) = CAST(ft.caseid AS VARCHAR) AND CAST(ex.vehno AS VARCHAR) = CAST(ft.vehno AS VARCHAR)",
    [_EXC, _FIRST]))
def q_lookup_truth_text_key(spark, sf_dir):
    return lookup(spark, sf_dir, "string").select("caseid", "vehno", "vehicles", "crashcat", "crashconf", "crashtype")


@register("vehicle_examples", sql=with_views(["gv", "narr"],
    f"SELECT g.caseid, g.vehno, {_focus_sql('n.summary', 'g.vehno')} AS summary, g.crashtype "
    "FROM gv g JOIN narr n USING (caseid) WHERE n.summary IS NOT NULL AND g.crashtype IS NOT NULL"))
def q_vehicle_examples(spark, sf_dir):
    v = Views(spark, sf_dir)
    return R.vehicle_examples(v.narr, v.gv, [])


_REASON = ("rs", "SELECT l.*, CASE WHEN crashcat IS NULL THEN 'missing_category' "
                 "WHEN crashcat = 9 THEN 'unknown_category' WHEN c.conf IS NULL THEN 'unknown_configuration' "
                 "WHEN crashtype IS NULL THEN 'missing_label' END AS reason "
                 "FROM (SELECT ex.caseid, ex.vehno, ft.crashcat, ft.crashconf, ft.crashtype FROM ex "
                 "LEFT JOIN ft USING (caseid, vehno)) l LEFT JOIN codebook c ON l.crashconf = c.conf")


def _lookup_rows(spark, sf_dir):
    return lookup(spark, sf_dir).select("caseid", "vehno", "crashcat", "crashconf", "crashtype")


@register("eligibility", sql=with_views(["cases", "gv_raw", "codebook"],
    "SELECT caseid, vehno, crashcat, crashconf, crashtype FROM rs WHERE reason IS NULL", [_EXC, _FIRST, _REASON]))
def q_eligibility(spark, sf_dir):
    return R.eligible(_lookup_rows(spark, sf_dir), Views(spark, sf_dir).codebook)


@register("eligibility_reasons", sql=with_views(["cases", "gv_raw", "codebook"],
    "SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM rs GROUP BY 1", [_EXC, _FIRST, _REASON]))
def q_eligibility_reasons(spark, sf_dir):
    return R.eligibility_reasons(_lookup_rows(spark, sf_dir), Views(spark, sf_dir).codebook)


_CAT_VALUES = ", ".join(f"({k}, '{v}')" for k, v in CRASHCAT_NAMES.items())


@register("category_options", sql=with_views("gv",
    f"SELECT g.crashcat, g.caseid, g.vehno, g.crashconf, g.crashtype, c.category_text FROM gv g "
    f"LEFT JOIN (VALUES {_CAT_VALUES}) c(crashcat, category_text) ON g.crashcat = c.crashcat"))
def q_category_options(spark, sf_dir):
    v = Views(spark, sf_dir)
    return R.with_category_options(v.gv, R.category_codebook(spark))


@register("configuration_options", sql=with_views("gv", CONF_OPTIONS_SQL, [CONF_CO]),
          note="letters that each category allows, with the remarks some of them carry")
def q_configuration_options(spark, sf_dir):
    return R.configuration_options(category_letters(Views(spark, sf_dir)))


@register("truth_list", sql=with_views("gv",
    "SELECT g.*, row_number() OVER (PARTITION BY caseid ORDER BY vehno) AS pos, "
    "count(*) OVER (PARTITION BY caseid) AS n_vehicles FROM gv g"))
def q_truth_list(spark, sf_dir):
    return R.truth_list(Views(spark, sf_dir).gv)


@register("single_vehicle_detail", sql=with_views(["cases", "gv", "vp1", "codebook"],
    "SELECT c.caseid, t.crashcat AS gt_cat, t.crashconf AS gt_conf, t.crashtype AS gt_type, p.crashtype AS pred_type, "
    "coalesce(CAST(p.crashtype = t.crashtype AS INTEGER), 0) AS correct "
    "FROM cases c JOIN gv t ON t.caseid = c.caseid AND t.vehno = 1 JOIN codebook k ON k.conf = t.crashconf "
    "JOIN vp1 p ON p.caseid = c.caseid AND p.vehno = 1 "
    "WHERE c.vehicles = 1 AND t.crashcat IS NOT NULL AND t.crashcat <> 9"))
def q_single_vehicle_detail(spark, sf_dir):
    v = Views(spark, sf_dir)
    return R.single_vehicle_detail(v.cases, v.gv, v.vpred, v.codebook)
