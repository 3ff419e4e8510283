"""Registered sampling / noise / split queries."""

from __future__ import annotations

from tallyspark.functions.codes import MANCOLL_CODES, NOISE_LEVELS, SWEEP_SIZES
from tallyspark.functions.hashing import sql_hash32
from tallyspark.operators import sample as S
from tallyspark.plans.registry import register
from tallyspark.sources.fixtures import Views, with_views

SEED = 42
_CODES = "[" + ", ".join(str(c) for c in MANCOLL_CODES) + "]"
_OTHERS = (f"CASE WHEN mancoll IS NULL THEN {_CODES} "
           f"ELSE list_filter({_CODES}, lambda x: x <> mancoll) END")


def _pick(key_sql: str) -> str:
    return f"({_OTHERS})[{sql_hash32(key_sql, repr(f'val{SEED}'))} % len({_OTHERS}) + 1]"


_RC = ("rc", f"SELECT caseid, mancoll, row_number() OVER (ORDER BY {sql_hash32('CAST(caseid AS VARCHAR)', repr(f'seed{SEED}'))}, "
             "caseid) AS rn, count(*) OVER () AS n FROM cases")


def _cases(spark, sf_dir):
    return Views(spark, sf_dir).cases.select("caseid", "mancoll")


@register("inject_label_noise", sql=with_views("cases",
    f"SELECT caseid, mancoll, CAST(CASE WHEN rn <= (n * 15) // 100 THEN {_pick('CAST(caseid AS VARCHAR)')} "
    "ELSE mancoll END AS INTEGER) AS mancoll_new, rn <= (n * 15) // 100 AS changed FROM rc", [_RC]))
def q_inject_label_noise(spark, sf_dir):
    return S.inject_label_noise(_cases(spark, sf_dir), ["caseid"], "mancoll", MANCOLL_CODES, 15, SEED)


_LEVELS = ", ".join(f"({p})" for p in NOISE_LEVELS)


@register("noise_ladder", sql=with_views("cases",
    f"SELECT l.noise_pct, caseid, mancoll, CAST(CASE WHEN rn <= (n * l.noise_pct) // 100 "
    f"THEN {_pick('CAST(caseid AS VARCHAR)')} ELSE mancoll END AS INTEGER) AS mancoll_new, "
    f"rn <= (n * l.noise_pct) // 100 AS changed FROM rc CROSS JOIN (VALUES {_LEVELS}) l(noise_pct)", [_RC]))
def q_noise_ladder(spark, sf_dir):
    return S.noise_ladder(_cases(spark, sf_dir), ["caseid"], "mancoll", MANCOLL_CODES, NOISE_LEVELS, SEED)


_GVKEY = "CAST(caseid AS VARCHAR) || '|' || CAST(vehno AS VARCHAR)"


@register("random_split", sql=with_views("gv",
    "SELECT caseid, vehno, crashcat, crashconf, crashtype, CASE WHEN rn <= t THEN 'test' WHEN rn <= t + v THEN 'val' "
    "ELSE 'train' END AS split FROM (SELECT *, ((n - t) * 10 + 99) // 100 AS v FROM (SELECT *, (n * 20 + 99) // 100 AS t "
    f"FROM (SELECT *, row_number() OVER (ORDER BY {sql_hash32(_GVKEY, repr(f'seed{SEED}'))}, {_GVKEY}) AS rn, "
    "count(*) OVER () AS n FROM gv)))"))
def q_random_split(spark, sf_dir):
    return S.random_split(Views(spark, sf_dir).gv, ["caseid", "vehno"], 20, 10, SEED)


@register("stratified_split", sql=with_views("cases",
    "SELECT c.caseid, c.mancoll, CASE WHEN c.rn <= q.quota THEN 'test' ELSE 'train' END AS split FROM "
    f"(SELECT caseid, mancoll, row_number() OVER (PARTITION BY mancoll ORDER BY "
    f"{sql_hash32('CAST(caseid AS VARCHAR)', repr(f'seed{SEED}'))}, caseid) AS rn FROM cases) c JOIN "
    "(SELECT mancoll, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, mancoll) <= t - sum(base) OVER () "
    "THEN 1 ELSE 0 END AS quota FROM (SELECT mancoll, nc, t, (nc * t) // n AS base, (nc * t) % n AS rem FROM ("
    "SELECT mancoll, nc, sum(nc) OVER () AS n, (sum(nc) OVER () * 20 + 99) // 100 AS t FROM "
    "(SELECT mancoll, count(*) AS nc FROM cases GROUP BY mancoll)))) q "
    "ON c.mancoll = q.mancoll OR (c.mancoll IS NULL AND q.mancoll IS NULL)"))
def q_stratified_split(spark, sf_dir):
    return S.stratified_split(_cases(spark, sf_dir), ["caseid"], "mancoll", 20, SEED)


@register("class_weights", sql=with_views("cases",
    "SELECT label, n, round((1.0 / (n + 1e-9)) / sum(1.0 / (n + 1e-9)) OVER () * count(*) OVER (), 6) AS weight "
    "FROM (SELECT mancoll AS label, count(*) AS n FROM cases WHERE mancoll IS NOT NULL GROUP BY mancoll)"))
def q_class_weights(spark, sf_dir):
    return S.class_weights(Views(spark, sf_dir).cases, "mancoll")


_SIZES = ", ".join(f"({s})" for s in SWEEP_SIZES)


@register("limit_sample_sweep", sql=with_views("cases",
    "SELECT s.size, t.pos, t.caseid, t.summary, t.vehicles, t.mancoll FROM (SELECT *, "
    f"CAST(row_number() OVER (ORDER BY caseid) AS INTEGER) AS pos FROM cases ORDER BY caseid LIMIT {max(SWEEP_SIZES)}) t "
    f"JOIN (VALUES {_SIZES}) s(size) ON t.pos <= s.size"))
def q_limit_sample_sweep(spark, sf_dir):
    return S.limit_sweep(Views(spark, sf_dir).cases, ["caseid"], SWEEP_SIZES)
