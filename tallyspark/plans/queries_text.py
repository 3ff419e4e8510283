"""Registered text/prompt/parse queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions.codes import CRASHCAT_NAMES, FOCUS_TEXT, MANCOLL_NAMES
from tallyspark.functions.hashing import hash32, sql_hash32
from tallyspark.operators import relate as R
from tallyspark.operators import text as T
from tallyspark.operators.heavy import top_words
from tallyspark.operators.promptcache import PromptCache, prompt_key
from tallyspark.operators.sample import random_split
from tallyspark.plans.queries_codes import _CB_SQL, _symbol_sql, codebook_from_gv
from tallyspark.plans.registry import register
from tallyspark.session import scratch_path
from tallyspark.sources.fixtures import GV_ORDER, Views, with_views

WS = r"[\t\n\x0B\f\r ]"
NW = r"[^\pL\p{Nd}_]"  # a non-word character under Java's default \b rules


def _focus_sql(text: str, vehno: str) -> str:
    """DuckDB form of T1: RE2's \\b is ASCII-only, so the Unicode-aware word
    boundary is spelled out; a second pass catches matches that shared a
    boundary character with the previous one."""
    v = f"CAST({vehno} AS VARCHAR)"
    pat = (f"'(^|{NW})(V#' || {v} || '|V' || {v} || '|Vehicle #' || {v} || '|Vehicle ' || {v} || ')({NW}|$)'")
    rep = f"'\\1{FOCUS_TEXT}\\3'"
    once = f"regexp_replace({text}, {pat}, {rep}, 'gi')"
    return f"regexp_replace({once}, {pat}, {rep}, 'gi')"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _template_sql(task: str, fields: dict[str, str]) -> str:
    parts = []
    for kind, v in T.template_parts(T.TEMPLATES[task]):
        parts.append(_lit(v) if kind == "lit" else f"coalesce(CAST({fields[v]} AS VARCHAR), '')")
    return " || ".join(parts)


_EX = ("ex", "SELECT caseid, summary, mancoll, unnest(generate_series(1, vehicles)) AS vehno FROM narr "
             "WHERE vehicles >= 1")


def narr_vehicles(spark, sf_dir):
    return R.explode_vehicles(Views(spark, sf_dir).narr)


@register("focus_vehicle", sql=with_views("narr",
    f"SELECT caseid, vehno, {_focus_sql('summary', 'vehno')} AS focus_text FROM ex", [_EX]))
def q_focus_vehicle(spark, sf_dir):
    return T.focus_vehicle(narr_vehicles(spark, sf_dir)).select("caseid", "vehno", "focus_text")


@register("split_by_vehicle", sql=with_views("narr",
    f"SELECT caseid, CAST(i - 1 AS INTEGER) AS pos, regexp_replace(seg, '^{WS}+|{WS}+$', '', 'g') AS segment, "
    r"regexp_extract(seg, '^Vehicle\s*(\d+)', 1) AS vehno_text FROM ("
    "SELECT caseid, unnest(range(1, len(arr) + 1)) AS i, unnest(arr) AS seg FROM ("
    r"SELECT caseid, string_split(regexp_replace(summary, '(Vehicle\s*\d+)', chr(1) || '\1', 'g'), chr(1)) AS arr "
    "FROM narr)) WHERE i > 1"))
def q_split_by_vehicle(spark, sf_dir):
    return T.split_by_vehicle(Views(spark, sf_dir).narr)


MANNER_OPTIONS = T.options_text(MANCOLL_NAMES)


@register("build_prompts", sql=with_views("narr",
    f"SELECT caseid, {_template_sql('manner', {'options': _lit(MANNER_OPTIONS), 'text': 'summary'})} AS prompt "
    "FROM narr"))
def q_build_prompts(spark, sf_dir):
    n = Views(spark, sf_dir).narr.withColumn("options", F.lit(MANNER_OPTIONS))
    return T.build_prompts(n, "manner", {"options": "options", "text": "summary"}).select("caseid", "prompt")


CONF_CO = ("co", "SELECT DISTINCT crashcat AS category, crashconf AS conf FROM gv WHERE crashcat IS NOT NULL")
CONF_OPTIONS_SQL = (
    "SELECT category, string_agg(conf || ': Configuration ' || conf, chr(10) ORDER BY conf) AS option_text, "
    "coalesce(string_agg('Note on ' || conf || ': check the trafficway', chr(10) ORDER BY conf) "
    "FILTER (WHERE conf IN ('C', 'K')), '') AS note FROM co GROUP BY category")


def category_letters(views):
    """(category, conf, meaning, remark): codebook rows derived from the labels."""
    g = views.gv.where("crashcat is not null").select(
        F.col("crashcat").alias("category"), F.col("crashconf").alias("conf")).distinct()
    return g.select("category", "conf", F.concat(F.lit("Configuration "), "conf").alias("meaning"),
                    F.when(F.col("conf").isin("C", "K"), F.lit("check the trafficway")).alias("remark"))


_LK = ("lk", "SELECT ex.*, g.crashcat, g.crashconf, g.crashtype FROM ex LEFT JOIN gv g USING (caseid, vehno)")
_FOCUS = _focus_sql("summary", "vehno")
_CAT_OPTIONS = T.options_text(CRASHCAT_NAMES)
_CAT_CASE = "CASE crashcat " + " ".join(f"WHEN {k} THEN {_lit(v)}" for k, v in CRASHCAT_NAMES.items()) + " END"


@register("sft_examples_manner", sql=with_views("narr",
    f"SELECT caseid, {_template_sql('manner', {'options': _lit(MANNER_OPTIONS), 'text': 'summary'})} AS prompt, "
    "CAST(mancoll AS VARCHAR) AS answer FROM narr WHERE summary IS NOT NULL AND mancoll IS NOT NULL"))
def q_sft_manner(spark, sf_dir):
    return T.sft_manner(Views(spark, sf_dir).narr)


@register("sft_examples_category", sql=with_views(["narr", "gv"],
    f"SELECT caseid, vehno, {_template_sql('category', {'vehno': 'vehno', 'options': _lit(_CAT_OPTIONS), 'text': _FOCUS})} "
    "AS prompt, CAST(crashcat AS VARCHAR) AS answer FROM lk WHERE crashcat BETWEEN 1 AND 6", [_EX, _LK]))
def q_sft_category(spark, sf_dir):
    v = Views(spark, sf_dir)
    return T.sft_category(v.narr, v.gv_raw, GV_ORDER)


@register("sft_examples_configuration", sql=with_views(["narr", "gv", "codebook"],
    "SELECT caseid, vehno, " + _template_sql("configuration", {
        "vehno": "vehno", "category": _CAT_CASE, "text": _FOCUS,
        "options": "concat_ws(chr(10), o.option_text, nullif(o.note, ''))"})
    + " AS prompt, crashconf AS answer FROM lk JOIN codebook c ON lk.crashconf = c.conf "
      "LEFT JOIN opt o ON o.category = lk.crashcat WHERE crashcat IS NOT NULL AND crashcat <> 9",
    [_EX, _LK, CONF_CO, ("opt", CONF_OPTIONS_SQL)]))
def q_sft_configuration(spark, sf_dir):
    v = Views(spark, sf_dir)
    return T.sft_configuration(v.narr, v.gv_raw, R.configuration_options(category_letters(v)), v.codebook, GV_ORDER)


@register("build_prompts_category", sql=with_views("narr",
    f"SELECT caseid, vehno, {_template_sql('category', {'vehno': 'vehno', 'options': _lit(_CAT_OPTIONS), 'text': _FOCUS})} "
    "AS prompt FROM ex", [_EX]), note="every vehicle, labelled or not")
def q_prompts_category(spark, sf_dir):
    return T.vehicle_prompts(Views(spark, sf_dir).narr, "category")


#: The least predicted value of each vehicle, whatever else its predictions say.
_KNOWN = ("known", "SELECT caseid, vehno, min(crashcat) AS crashcat, min(crashconf) AS crashconf FROM vpred GROUP BY ALL")


@register("build_prompts_configuration", sql=with_views(["narr", "gv", "vpred"],
    "SELECT caseid, vehno, " + _template_sql("configuration", {
        "vehno": "vehno", "category": _CAT_CASE, "text": _FOCUS,
        "options": "concat_ws(chr(10), o.option_text, nullif(o.note, ''))"})
    + f" AS prompt FROM ex JOIN known k USING (caseid, vehno) JOIN opt o ON o.category = k.crashcat "
      f"WHERE crashcat IN ({', '.join(map(str, CRASHCAT_NAMES))})",
    [_EX, _KNOWN, CONF_CO, ("opt", CONF_OPTIONS_SQL)]), note="category as predicted before")
def q_prompts_configuration(spark, sf_dir):
    v = Views(spark, sf_dir).kept_vehicles()
    return T.vehicle_prompts(v.narr, "configuration", v.vpred, R.configuration_options(category_letters(v)))


@register("build_prompts_type", sql=with_views(["narr", "gv", "vpred"],
    "SELECT caseid, vehno, "
    + _template_sql("type", {"vehno": "vehno", "options": "o.options", "text": _FOCUS})
    + " AS prompt FROM ex JOIN known k USING (caseid, vehno) JOIN opt o ON o.conf = k.crashconf",
    [_EX, _KNOWN, ("opt", _CB_SQL)]), note="configuration as predicted before")
def q_prompts_type(spark, sf_dir):
    v = Views(spark, sf_dir)
    return T.vehicle_prompts(v.narr, "type", v.vpred, codebook_from_gv(spark, sf_dir))


_TYPE_SQL = ("SELECT el.caseid, el.vehno, "
    + _template_sql("type", {"vehno": "el.vehno", "options": "o.options", "text": _focus_sql("el.summary", "el.vehno")})
    + " AS prompt, CASE WHEN el.crashtype - el.code_offset < 10 THEN CAST(el.crashtype - el.code_offset AS VARCHAR) "
      "ELSE chr(CAST(el.crashtype - el.code_offset + 55 AS INTEGER)) END AS answer "
      "FROM el LEFT JOIN opt o ON el.crashconf = o.conf")
_TYPE_CTES = [_EX, _LK, ("el", "SELECT lk.*, c.code_offset FROM lk JOIN codebook c ON lk.crashconf = c.conf "
                               "WHERE lk.crashtype IS NOT NULL"), ("opt", _CB_SQL)]


@register("sft_examples", sql=with_views(["narr", "gv", "codebook"], _TYPE_SQL, _TYPE_CTES))
def q_sft_examples(spark, sf_dir):
    """T4, crash type.  The options, a row per configuration, are derived from all
    vehicles once and kept, not again for every job that reads them."""
    v = Views(spark, sf_dir)
    path = scratch_path(spark, "options")
    codebook_from_gv(spark, sf_dir).write.parquet(path)
    return T.sft_type(v.narr, v.gv_raw, spark.read.parquet(path), v.codebook, GV_ORDER)


@register("sft_examples_first", sql=with_views(["narr", "gv", "codebook"],
    f"SELECT * FROM ({_TYPE_SQL}) ORDER BY caseid, vehno LIMIT 200", _TYPE_CTES),
    note="the limited variant: the first 200 examples (the limit is the feature)")
def q_sft_examples_first(spark, sf_dir):
    return T.first_examples(q_sft_examples(spark, sf_dir), ["caseid", "vehno"], 200)


_PROMPT_SQL = _template_sql("manner", {"options": _lit(MANNER_OPTIONS), "text": "summary"})


@register("prompt_dedupe_cache", sql=with_views("narr",
    "SELECT d.prompt_key, c.answer, c.answer IS NOT NULL AS cached FROM "
    "(SELECT DISTINCT md5(prompt) AS prompt_key FROM p) d LEFT JOIN "
    "(SELECT md5(prompt) AS prompt_key, min(CAST(mancoll AS VARCHAR)) AS answer FROM p "
    f"WHERE {sql_hash32('caseid', chr(39) + 'cache' + chr(39))} % 3 = 0 GROUP BY 1) c USING (prompt_key)",
    [("p", f"SELECT caseid, mancoll, {_PROMPT_SQL} AS prompt FROM narr")]),
    note="cache = answers already known for a hash-chosen third of the cases")
def q_prompt_dedupe_cache(spark, sf_dir):
    n = Views(spark, sf_dir).narr.withColumn("options", F.lit(MANNER_OPTIONS))
    p = T.build_prompts(n, "manner", {"options": "options", "text": "summary"})
    cache = (p.where(hash32("caseid", "cache") % 3 == 0)
             .select(F.md5("prompt").alias("prompt_key"), F.col("mancoll").cast("string").alias("answer")))
    return T.with_cache(p, cache).select("prompt_key", "answer", "cached")


@register("prompt_cache_table", sql=with_views("narr",
    "SELECT md5(prompt) AS prompt_key, min(CAST(mancoll AS VARCHAR)) AS answer, "
    f"count_if({sql_hash32('caseid', chr(39) + 'cache' + chr(39))} % 3 = 0 AND mancoll IS NOT NULL) > 0 AS known_before "
    "FROM p GROUP BY 1 HAVING min(mancoll) IS NOT NULL",
    [("p", f"SELECT caseid, mancoll, {_PROMPT_SQL} AS prompt FROM narr")]),
    note="a bucketed cache is filled with a third of the answers, then with those of its misses, and asked again")
def q_prompt_cache_table(spark, sf_dir):
    n = Views(spark, sf_dir).narr.withColumn("options", F.lit(MANNER_OPTIONS))
    p = T.build_prompts(n, "manner", {"options": "options", "text": "summary"})
    path = scratch_path(spark, "prompts")
    p.select("caseid", "mancoll", "prompt").write.parquet(path)
    p = spark.read.parquet(path)
    # answers that a model would give: the label of the prompt's cases, the smallest by text
    answers = (p.where("mancoll is not null").groupBy(prompt_key()).agg(F.min(F.col("mancoll").cast("string")).alias("answer")))
    first = p.where((hash32("caseid", "cache") % 3 == 0) & F.col("mancoll").isNotNull()).select(prompt_key())
    folder = scratch_path(spark, "prompt-cache")
    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cache = PromptCache("prompt_cache_" + folder.rsplit("-", 1)[-1], folder, buckets).open(spark)
    cache.add(answers.join(first, "prompt_key", "left_semi"))
    before = cache.lookup(p)
    asked = scratch_path(spark, "prompt-lookup")
    before.select("prompt_key", F.col("cached").alias("known_before")).write.parquet(asked)
    before = spark.read.parquet(asked)
    cache.add(answers.join(before.where("not known_before"), "prompt_key", "left_semi"))
    return (cache.lookup(p).where("cached").join(before, "prompt_key").select("prompt_key", "answer", "known_before"))


_PARSE_SQL = {
    "digit": r"coalesce(CAST(nullif(regexp_extract(answer, '\b([0-9])\b', 1), '') AS INTEGER), 9)",
    "leading_digit": r"coalesce(CAST(nullif(substr(regexp_extract(answer, '(\d+)', 1), 1, 1), '') AS INTEGER), 9)",
    "letter": r"nullif(regexp_extract(answer, '\b([A-Z])\b', 1), '')",
    "symbol": _symbol_sql("answer"),
}
_PARSE_KEYS = {"digit": "parse_digit", "leading_digit": "parse_first_digit", "letter": "parse_letter",
               "symbol": "parse_symbol"}


def _parse_query(rule):
    def q(spark, sf_dir):
        return T.parse_responses(Views(spark, sf_dir).resp, "answer", rule)
    return q


for _rule, _key in _PARSE_KEYS.items():
    register(_key, sql=with_views("resp", f"SELECT id, answer, {_PARSE_SQL[_rule]} AS parsed FROM resp"))(
        _parse_query(_rule))


@register("parse_failure_rate", sql=with_views("resp",
    "SELECT count(*) AS n, round(avg(CASE WHEN regexp_extract(answer, '\\b([0-9])\\b', 1) = '' "
    "THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS failure_rate FROM resp"))
def q_parse_failure_rate(spark, sf_dir):
    return T.parse_failure_rate(Views(spark, sf_dir).resp, "answer", "digit")


@register("parse_failure_by_model", sql=with_views("resp",
    "SELECT id % 3 AS model, count(*) AS n, round(avg(CASE WHEN regexp_extract(answer, '\\b([A-Z])\\b', 1) = '' "
    "THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS failure_rate FROM resp GROUP BY 1"))
def q_parse_failure_by_model(spark, sf_dir):
    r = Views(spark, sf_dir).resp.withColumn("model", F.col("id") % 3)
    return T.parse_failure_rate(r, "answer", "letter", ["model"])


#: Answers where a rule finds nothing, per model (the letter rule's key is above).
_FAILED_SQL = {"digit": r"regexp_extract(answer, '\b([0-9])\b', 1) = ''", "leading_digit": r"regexp_extract(answer, '(\d+)', 1) = ''",
               "symbol": f"({_symbol_sql('answer')}) IS NULL"}


def _failure_query(rule):
    def q(spark, sf_dir):
        r = Views(spark, sf_dir).resp.withColumn("model", F.col("id") % 3)
        return T.parse_failure_rate(r, "answer", rule, ["model"])
    return q


for _rule, _failed in _FAILED_SQL.items():
    register(f"{_PARSE_KEYS[_rule]}_failure_by_model", sql=with_views("resp",
        f"SELECT id % 3 AS model, count(*) AS n, round(avg(CASE WHEN coalesce({_failed}, true) THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) "
        "AS failure_rate FROM resp GROUP BY 1"))(_failure_query(_rule))


@register("argmax_class", sql=with_views("emb",
    "SELECT vec_id, label, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS pred_index "
    "FROM emb"))
def q_argmax_class(spark, sf_dir):
    return T.argmax_class(Views(spark, sf_dir).emb, "embedding").select("vec_id", "label", "pred_index")


_VOCAB = ("vocab", "SELECT word, CAST(row_number() OVER (ORDER BY n DESC, word) + 1 AS INTEGER) AS id, n FROM ("
          f"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '{WS}+')) AS word "
          "FROM train) WHERE word <> '' GROUP BY word ORDER BY n DESC, word LIMIT 20000)")


_TRAIN = ("train", "SELECT * FROM docs QUALIFY row_number() OVER (ORDER BY "
          f"{sql_hash32('doc_id', repr('seed42'))}, doc_id) > (20 * count(*) OVER () + 99) // 100")


def train_vocab(spark, sf_dir):
    """Words of the training split (N3, 80 %) only."""
    d = Views(spark, sf_dir).docs
    return T.build_vocab(random_split(d, ["doc_id"], 20, 0, 42).where("split = 'train'"), "text", 20000)


@register("build_vocab", sql=with_views("docs", "SELECT word, id, n FROM vocab", [_TRAIN, _VOCAB]))
def q_build_vocab(spark, sf_dir):
    return train_vocab(spark, sf_dir)


@register("build_vocab_bounded", sql=with_views("docs", "SELECT word, id, n FROM vocab", [_TRAIN, _VOCAB]),
          note="the same vocabulary by a sketch of counts and an exact second pass")
def q_build_vocab_bounded(spark, sf_dir):
    d = Views(spark, sf_dir).docs
    return top_words(random_split(d, ["doc_id"], 20, 0, 42).where("split = 'train'"), "text", 20000)


@register("encode_tokens", sql=with_views("docs",
    "SELECT d.doc_id, coalesce(e.ids, []::INTEGER[]) AS token_ids FROM docs d LEFT JOIN ("
    "SELECT t.doc_id, list(coalesce(v.id, 1) ORDER BY t.pos) AS ids FROM ("
    "SELECT doc_id, unnest(range(1, len(arr) + 1)) AS pos, unnest(arr) AS word FROM ("
    f"SELECT doc_id, regexp_split_to_array(lower(text), '{WS}+') AS arr FROM docs)) t "
    "LEFT JOIN vocab v USING (word) WHERE t.word <> '' GROUP BY t.doc_id) e USING (doc_id)", [_TRAIN, _VOCAB]))
def q_encode_tokens(spark, sf_dir):
    return T.encode_tokens(Views(spark, sf_dir).docs, train_vocab(spark, sf_dir), "text")
