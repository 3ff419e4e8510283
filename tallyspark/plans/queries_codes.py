"""Registered code/codebook queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions.codes import INDEX_TO_MANCOLL, MANCOLL_NAMES
from tallyspark.operators import codes as C
from tallyspark.operators.text import argmax_class
from tallyspark.plans.registry import register
from tallyspark.sources.fixtures import CONF_LETTERS, Views, with_views

LETTERS = list(CONF_LETTERS)


def _norm_sql(c: str) -> str:
    return (f"regexp_replace(regexp_replace(CAST({c} AS VARCHAR), '^\\s+|\\s+$', '', 'g'), "
            f"'^(-?\\d+)\\.0+$', '\\1')")


@register("normalise_labels", sql=with_views("pred_text",
    f"SELECT sid, model, run, {_norm_sql('gt_raw')} AS gt_raw, {_norm_sql('pred_raw')} AS pred_raw FROM pred_text"))
def q_normalise_labels(spark, sf_dir):
    return C.normalise_labels(Views(spark, sf_dir).pred_text, ["gt_raw", "pred_raw"])


_MAP_GV = ("m", "SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id "
                "FROM (SELECT DISTINCT crashtype AS label FROM gv WHERE crashtype IS NOT NULL)")


@register("label_mapping", sql=with_views("gv", "SELECT label, label_id FROM m", [_MAP_GV]))
def q_label_mapping(spark, sf_dir):
    return C.label_mapping(Views(spark, sf_dir).gv, "crashtype")


@register("encode_labels_ranged", sql=(
    "WITH m AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_id FROM "
    "(SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS label FROM lineitem WHERE l_orderkey IS NOT NULL)) "
    "SELECT l_orderkey, l_linenumber, label_id FROM lineitem JOIN m ON label = CAST(l_orderkey AS VARCHAR)"),
    note="C2 for a label set that grows with the data: case ids as text labels")
def q_encode_labels_ranged(spark, sf_dir):
    rows = Views(spark, sf_dir).table("lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_orderkey").cast("string").alias("label"))
    mapping = C.label_mapping_ranged(rows, "label")
    return C.apply_encoding(rows, "label", mapping, "drop").drop("label")


@register("encode_labels", sql=with_views("gv",
    "SELECT g.*, m.label_id FROM gv g LEFT JOIN m ON g.crashtype = m.label", [_MAP_GV]))
def q_encode_labels(spark, sf_dir):
    return C.encode_labels(Views(spark, sf_dir).gv, "crashtype")[0]


@register("apply_encoding", sql=with_views(["gv", "vpred"],
    "SELECT g.*, m.label_id FROM gv g JOIN m ON g.crashtype = m.label",
    [("m", "SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id "
           "FROM (SELECT DISTINCT crashtype AS label FROM vpred WHERE crashtype IS NOT NULL)")]),
    note="mapping learnt on predictions, applied to truth; unseen labels dropped")
def q_apply_encoding(spark, sf_dir):
    v = Views(spark, sf_dir)
    return C.apply_encoding(v.gv, "crashtype", C.label_mapping(v.vpred, "crashtype"), on_unseen="drop")


_REMAP_CASE = "CASE idx " + " ".join(f"WHEN {k} THEN {v}" for k, v in INDEX_TO_MANCOLL.items()) + " ELSE idx END"


@register("remap_codes", sql=with_views("emb",
    f"SELECT vec_id, label, idx AS pred_index, CAST({_REMAP_CASE} AS INTEGER) AS pred_code FROM ("
    "SELECT vec_id, label, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS idx FROM emb)"))
def q_remap_codes(spark, sf_dir):
    e = argmax_class(Views(spark, sf_dir).emb, "embedding", "pred_index")
    return C.remap_codes(e.select("vec_id", "label", "pred_index"), "pred_index", out="pred_code")


def _name_case(c: str) -> str:
    return "CASE " + c + " " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in MANCOLL_NAMES.items()) + " END"


@register("code_meaning", sql=with_views("pred_long",
    f"SELECT sid, model, run, gt, pred, {_name_case('gt')} AS gt_name, {_name_case('pred')} AS pred_name "
    "FROM pred_long"))
def q_code_meaning(spark, sf_dir):
    return C.with_meaning(Views(spark, sf_dir).pred_long, {"gt": "gt_name", "pred": "pred_name"}, MANCOLL_NAMES)


_OFF = "CAST(floor(lo / 7) * 7 AS INTEGER)"
_CB_SQL = (
    f"SELECT conf, {_OFF} AS code_offset, '{{' || array_to_string(list_transform(types, "
    f"lambda t: printf('%d: ''type %d''', t - {_OFF}, t)), ',' || chr(10) || '    ') || '}}' AS options, "
    "'Configuration ' || conf AS class_text FROM (SELECT crashconf AS conf, min(crashtype) AS lo, "
    "list_sort(list_distinct(list(crashtype))) AS types FROM gv "
    "WHERE crashconf IS NOT NULL AND crashtype IS NOT NULL GROUP BY crashconf)")


def codebook_from_gv(spark, sf_dir):
    gv = Views(spark, sf_dir).gv
    return C.unpivot_codebook(C.codebook_sheet(gv, LETTERS), LETTERS)


@register("unpivot_codebook", sql=with_views("gv", _CB_SQL),
          note="transposed sheet derived from vehicle labels, then unpivoted")
def q_unpivot_codebook(spark, sf_dir):
    return codebook_from_gv(spark, sf_dir)


_OPT_SQL = ("SELECT conf, CAST(unnest(regexp_extract_all(options, '(\\d+): ', 1)) AS INTEGER) AS code, "
            "unnest(regexp_extract_all(options, ': ''([^'']*)''', 1)) AS meaning FROM cb")


@register("parse_options", sql=with_views("gv", _OPT_SQL, [("cb", _CB_SQL)]),
          note="oracle extracts the pairs with regexes (generated options hold no escaped quotes)")
def q_parse_options(spark, sf_dir):
    return C.parse_options(codebook_from_gv(spark, sf_dir))[0]


_ENC = ("enc", "SELECT g.*, c.code_offset, CASE WHEN g.crashtype - c.code_offset < 10 "
               "THEN CAST(g.crashtype - c.code_offset AS VARCHAR) "
               "ELSE chr(CAST(g.crashtype - c.code_offset + 55 AS INTEGER)) END AS local_code "
               "FROM {src} g JOIN codebook c ON g.crashconf = c.conf")


@register("local_code_encode", sql=with_views(["gv", "codebook"], "SELECT * FROM enc",
                                               [(_ENC[0], _ENC[1].format(src="gv"))]))
def q_local_code_encode(spark, sf_dir):
    v = Views(spark, sf_dir)
    return C.encode_local(v.gv, v.codebook)


def _symbol_sql(c: str) -> str:
    s = c
    for ch, num in (("A", 10), ("B", 11), ("C", 12), ("D", 13)):
        s = f"replace({s}, '{ch}', '{num}')"
    m = f"regexp_extract({s}, '\\b(\\d+)\\b', 1)"
    return f"CASE WHEN {m} <> '' THEN CAST(right({m}, 2) AS INTEGER) END"


@register("local_code_decode", sql=with_views(["vpred", "codebook"],
    f"SELECT e.*, CAST({_symbol_sql('e.local_code')} + c2.code_offset AS INTEGER) AS decoded_type "
    "FROM enc e LEFT JOIN codebook c2 ON e.crashconf = c2.conf",
    [(_ENC[0], _ENC[1].format(src="vpred"))]))
def q_local_code_decode(spark, sf_dir):
    v = Views(spark, sf_dir)
    return C.decode_local(C.encode_local(v.vpred, v.codebook), v.codebook)


@register("sample_hash_id", sql=with_views("narr",
    "SELECT caseid, substr(md5(coalesce(summary, '') || '||' || coalesce(CAST(mancoll AS VARCHAR), '')), 1, 10) "
    "AS sample_id FROM narr"))
def q_sample_hash_id(spark, sf_dir):
    n = Views(spark, sf_dir).narr
    return n.select("caseid", C.sample_hash_id(F.col("summary"), F.col("mancoll")).alias("sample_id"))


_STAR_SQL = ("p", "SELECT model, run, sid, gt, CASE WHEN model = 'm2' THEN '*' ELSE 'Case ' || CAST(sid AS VARCHAR) "
                  "END AS summary FROM pred_long")


@register("sample_id_occurrence", sql=with_views("pred_long",
    "SELECT model, run, sid, sh || '#' || CAST(row_number() OVER (PARTITION BY model, run, sh ORDER BY sid) "
    "AS VARCHAR) AS sample_id FROM (SELECT *, md5(coalesce(summary, '') || '||' || "
    "coalesce(CAST(gt AS VARCHAR), '')) AS sh FROM p)", [_STAR_SQL]),
    note="model m2 writes '*' as every summary: ids stay unique via occurrence numbers")
def q_sample_id_occurrence(spark, sf_dir):
    p = Views(spark, sf_dir).pred_long
    src = p.select("model", "run", "sid", "gt",
                   F.when(F.col("model") == "m2", F.lit("*"))
                    .otherwise(F.concat(F.lit("Case "), F.col("sid").cast("string"))).alias("summary"))
    return C.with_sample_id(src, "summary", "gt", ["model", "run"], ["sid"]).select("model", "run", "sid", "sample_id")


@register("apply_encoding_strict", sql=with_views("gv",
    "SELECT g.caseid, g.vehno, g.crashtype, m.id AS label_id FROM gv g LEFT JOIN (SELECT crashtype, CAST(row_number() OVER "
    "(ORDER BY crashtype) - 1 AS INTEGER) AS id FROM (SELECT DISTINCT crashtype FROM gv WHERE crashtype IS NOT NULL)) m "
    "USING (crashtype)"),
    note="C3 raise mode: every label is known here; tests feed it an unseen one")
def q_apply_encoding_strict(spark, sf_dir):
    g = Views(spark, sf_dir).gv.select("caseid", "vehno", "crashtype")
    return C.apply_encoding(g, "crashtype", C.label_mapping(g, "crashtype"), "raise")
