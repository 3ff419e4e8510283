"""Text, prompts and answer parsing as table jobs.

Everything here is a JVM-side column expression or a hash aggregate; no
Python runs per row.  Regexes use Java semantics (Unicode-aware ``\\b``).
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyspark.functions.codes import CRASHCAT_NAMES, FOCUS_TEXT, MANCOLL_NAMES, SYMBOL_LETTERS
from tallyspark.functions.joins import checked_broadcast

WS = r"[\t\n\x0B\f\r ]"  # ASCII whitespace, same set in Java and RE2


# -- T1 -----------------------------------------------------------------------

def focus_pattern(vehno: Column) -> Column:
    """Per-row regex: the letter V or the word Vehicle and one space, an optional
    hash sign, the number; a whole word, any case."""
    return F.format_string(r"(?i)\bV(?:ehicle\x20)?#?%d\b", vehno.cast("int"))


def focus_vehicle(df: DataFrame, text_col: str = "summary", vehno_col: str = "vehno",
                  out: str = "focus_text", replacement: str = FOCUS_TEXT) -> DataFrame:
    """Rewrite references to the vehicle being classified."""
    rep = replacement.replace("\\", "\\\\").replace("$", "\\$")
    return df.withColumn(out, F.regexp_replace(F.col(text_col), focus_pattern(F.col(vehno_col)), F.lit(rep)))


# -- T2 -----------------------------------------------------------------------

def split_by_vehicle(df: DataFrame, text_col: str = "summary", key: str = "caseid") -> DataFrame:
    """Segments that start at each 'Vehicle N'; text before the first is dropped.

    The text is split where a 'Vehicle N' follows and the part before the first
    is dropped; segments are stripped.
    """
    cut = F.split(F.concat(F.lit(" "), F.col(text_col)), r"(?=Vehicle\s*\d)")
    parts = df.select(key, F.posexplode(cut).alias("pos", "segment"))
    seg = F.regexp_replace(F.col("segment"), rf"^{WS}+|{WS}+$", "")
    return parts.where(F.col("pos") > 0).select(
        key, F.col("pos").cast("int").alias("pos"), seg.alias("segment"),
        F.regexp_extract(F.col("segment"), r"^Vehicle\s*(\d+)", 1).alias("vehno_text"))


# -- T3 -----------------------------------------------------------------------

# Prompt templates (our own wording); fields in braces are filled per row.
TEMPLATES = {
    "manner": ("Classify the manner of collision of this crash.\n"
               "Classes:\n{options}\n"
               "Narrative:\n\"\"\"{text}\"\"\"\n"
               "Answer with the class number only."),
    "category": ("Assign a crash category to vehicle {vehno}.\n"
                 "Categories:\n{options}\n"
                 "Narrative:\n\"\"\"{text}\"\"\"\n"
                 "Answer with one digit."),
    "configuration": ("Assign a crash configuration letter to vehicle {vehno}.\n"
                      "Category: {category}\n"
                      "Configurations:\n{options}\n"
                      "Narrative:\n\"\"\"{text}\"\"\"\n"
                      "Answer with one capital letter."),
    "type": ("Assign a crash type to vehicle {vehno}.\n"
             "Crash types:\n{options}\n"
             "Narrative:\n\"\"\"{text}\"\"\"\n"
             "Answer with one number or letter from the list."),
}


def template_parts(template: str) -> list[tuple[str, str]]:
    """[('lit', text) | ('field', name)] in order."""
    out = []
    for lit, field, _, _ in string.Formatter().parse(template):
        if lit:
            out.append(("lit", lit))
        if field:
            out.append(("field", field))
    return out


def fill_template(template: str, fields: dict[str, Column]) -> Column:
    parts = []
    for kind, v in template_parts(template):
        parts.append(F.lit(v) if kind == "lit" else F.coalesce(fields[v].cast("string"), F.lit("")))
    return F.concat(*parts)


def build_prompts(df: DataFrame, task: str, fields: dict[str, str], out: str = "prompt") -> DataFrame:
    """Fill a task template per row; ``fields`` maps template field → column."""
    return df.withColumn(out, fill_template(TEMPLATES[task], {k: F.col(v) for k, v in fields.items()}))


def options_text(names: dict) -> str:
    return "\n".join(f"{k}: {v}" for k, v in names.items())


def vehicle_prompts(cases: DataFrame, task: str, known: DataFrame | None = None, options: DataFrame | None = None,
                    text_col: str = "summary") -> DataFrame:
    """T3 per vehicle: (caseid, vehno, prompt) for vehicles still to be classified;
    no label of the task itself is read.

    ``category``: every vehicle number of every case.  ``configuration``:
    vehicles whose category ``known`` (caseid, vehno, crashcat; an earlier answer or
    the truth) tells, with the letters and notes that ``options`` (category,
    option_text, note; R6) allows it.  ``type``: vehicles whose configuration
    ``known`` (caseid, vehno, crashconf) tells, with the types of ``options``
    (conf, options).  Vehicles without such an earlier answer, or with one
    that has no options, get no prompt, as nothing could be chosen.  A repeated
    key of ``known`` counts with its least value; a null text is empty.
    """
    from tallyspark.operators.relate import explode_vehicles, first_per_key
    rows = focus_vehicle(explode_vehicles(cases), text_col, "vehno", out="focus_text")
    fields = {"vehno": "vehno", "options": "options", "text": "focus_text"}
    if task == "category":
        rows = rows.withColumn("options", F.lit(options_text(CRASHCAT_NAMES)))
    elif task in ("configuration", "type"):
        value = {"configuration": "crashcat", "type": "crashconf"}[task]
        if task == "configuration":
            names = F.create_map(*[x for k, v in CRASHCAT_NAMES.items() for x in (F.lit(k), F.lit(v))])
            options = options.select(F.col("category").alias(value), F.concat_ws(
                "\n", "option_text", F.when(F.col("note") != "", F.col("note"))).alias("options"))
            options = options.withColumn("category", F.try_element_at(names, F.col(value))).where("category is not null")
            fields["category"] = "category"
        else:
            options = options.select(F.col("conf").alias(value), "options")
        first = first_per_key(known.where(F.col(value).isNotNull()), ["caseid", "vehno"], [], [value])
        rows = rows.join(first, ["caseid", "vehno"]).join(checked_broadcast(options), value)
    else:
        raise ValueError(f"no prompts per vehicle for task {task!r}")
    return build_prompts(rows, task, fields).select("caseid", "vehno", "prompt")


# -- T4 -----------------------------------------------------------------------

def sft_manner(cases: DataFrame, text_col: str = "summary", label: str = "mancoll") -> DataFrame:
    """T4, manner of collision: (caseid, prompt, answer) for every case with a
    text and a label."""
    ok = cases.where(F.col(text_col).isNotNull() & F.col(label).isNotNull())
    p = build_prompts(ok.withColumn("options", F.lit(options_text(MANCOLL_NAMES))), "manner",
                      {"options": "options", "text": text_col})
    return p.select("caseid", "prompt", F.col(label).cast("string").alias("answer"))


def _vehicle_rows(cases: DataFrame, gv: DataFrame, order: list[str], text_col: str) -> DataFrame:
    from tallyspark.operators.relate import explode_vehicles, lookup_truth
    rows = lookup_truth(explode_vehicles(cases), gv, order)
    return focus_vehicle(rows, text_col, "vehno", out="focus_text")


def sft_category(cases: DataFrame, gv: DataFrame, order: list[str], text_col: str = "summary") -> DataFrame:
    """T4, crash category: (caseid, vehno, prompt, answer) for vehicles with a
    known category."""
    ok = _vehicle_rows(cases, gv, order, text_col).where(F.col("crashcat").isin(list(CRASHCAT_NAMES)))
    p = build_prompts(ok.withColumn("options", F.lit(options_text(CRASHCAT_NAMES))), "category",
                      {"vehno": "vehno", "options": "options", "text": "focus_text"})
    return p.select("caseid", "vehno", "prompt", F.col("crashcat").cast("string").alias("answer"))


def sft_configuration(cases: DataFrame, gv: DataFrame, options: DataFrame, codebook: DataFrame, order: list[str],
                      text_col: str = "summary") -> DataFrame:
    """T4, configuration: for vehicles with a known category and a configuration
    of the codebook.  ``options``: (category, option_text, note) as R6 makes
    them; the notes follow the options."""
    from tallyspark.operators.relate import CHECKS, eligible
    ok = eligible(_vehicle_rows(cases, gv, order, text_col), codebook, CHECKS[:3])
    o = checked_broadcast(options.select(F.col("category").alias("crashcat"), F.concat_ws(
        "\n", F.col("option_text"), F.when(F.col("note") != "", F.col("note"))).alias("options")))
    named = F.create_map(*[x for k, v in CRASHCAT_NAMES.items() for x in (F.lit(k), F.lit(v))])
    rows = ok.join(o, "crashcat", "left").withColumn("category", F.try_element_at(named, F.col("crashcat")))
    p = build_prompts(rows, "configuration", {"vehno": "vehno", "category": "category", "options": "options",
                                              "text": "focus_text"})
    return p.select("caseid", "vehno", "prompt", F.col("crashconf").alias("answer"))


def sft_type(cases: DataFrame, gv: DataFrame, options: DataFrame, codebook: DataFrame, order: list[str],
             text_col: str = "summary") -> DataFrame:
    """T4, crash type: for vehicles with a type and a configuration of the
    codebook, whatever their category; the answer is the configuration's local
    symbol.  ``options``: (conf, options)."""
    from tallyspark.operators.codes import encode_local
    from tallyspark.operators.relate import eligible
    ok = eligible(_vehicle_rows(cases, gv, order, text_col), codebook, ("unknown_configuration", "missing_label"))
    o = checked_broadcast(options.select(F.col("conf").alias("crashconf"), "options"))
    p = build_prompts(ok.join(o, "crashconf", "left"), "type", {"vehno": "vehno", "options": "options", "text": "focus_text"})
    return encode_local(p, codebook, out="answer").select("caseid", "vehno", "prompt", "answer")


def first_examples(examples: DataFrame, order: list[str], n: int) -> DataFrame:
    """T4's limited variant: the first ``n`` examples in ``order``."""
    from tallyspark.sources.io import head_n
    return head_n(examples, order, n)


# -- T6 -----------------------------------------------------------------------

def with_cache(prompts: DataFrame, cache: DataFrame, prompt_col: str = "prompt") -> DataFrame:
    """Distinct prompts by md5 key, joined to a cache of known answers.

    Returns (prompt_key, prompt, answer, cached): ``cached`` rows reuse the
    stored answer, the rest are the misses still to send to the model.
    """
    keyed = prompts.select(F.md5(F.col(prompt_col)).alias("prompt_key"), F.col(prompt_col).alias("prompt"))
    distinct = keyed.groupBy("prompt_key").agg(F.min("prompt").alias("prompt"))
    c = cache.groupBy("prompt_key").agg(F.min("answer").alias("answer"), F.lit(True).alias("cached"))
    return distinct.join(c, "prompt_key", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


# -- T7–T10 ---------------------------------------------------------------------

def _nz(c: Column) -> Column:
    return F.when(c != "", c)


def parse_digit(c: Column) -> Column:
    """First stand-alone digit; none → 9."""
    return F.coalesce(_nz(F.regexp_extract(c, r"\b([0-9])\b", 1)).cast("int"), F.lit(9))


def parse_leading_digit(c: Column) -> Column:
    """First digit of the first number; none → 9."""
    return F.coalesce(_nz(F.substring(F.regexp_extract(c, r"(\d+)", 1), 1, 1)).cast("int"), F.lit(9))


def parse_letter(c: Column) -> Column:
    """First stand-alone capital letter; none → null."""
    return _nz(F.regexp_extract(c, r"\b([A-Z])\b", 1))


def parse_symbol(c: Column, letters: dict | None = None) -> Column:
    """A→10 … D→13 anywhere, then the first whole-word integer mod 100."""
    from tallyspark.operators.codes import symbol_number
    return symbol_number(c, letters or SYMBOL_LETTERS)


PARSERS = {"digit": parse_digit, "leading_digit": parse_leading_digit,
           "letter": parse_letter, "symbol": parse_symbol}


def parse_responses(df: DataFrame, col: str, rule: str, out: str = "parsed") -> DataFrame:
    return df.withColumn(out, PARSERS[rule](F.col(col)))


def parse_failure_rate(df: DataFrame, col: str, rule: str, by: list[str] | None = None) -> DataFrame:
    """Share of answers where the rule found nothing (fell back / null)."""
    by = by or []
    raw = {"digit": F.regexp_extract(F.col(col), r"\b([0-9])\b", 1),
           "leading_digit": F.regexp_extract(F.col(col), r"(\d+)", 1),
           "letter": F.regexp_extract(F.col(col), r"\b([A-Z])\b", 1)}.get(rule)
    miss = (F.coalesce(raw, F.lit("")) == "") if raw is not None else PARSERS[rule](F.col(col)).isNull()
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                               F.round(F.avg(miss.cast("double")), 6).alias("failure_rate"))


# -- T11 --------------------------------------------------------------------------

def argmax_class(df: DataFrame, col: str, out: str = "pred_index") -> DataFrame:
    """Index of the first maximum of a score vector."""
    return df.withColumn(out, (F.array_position(F.col(col), F.array_max(F.col(col))) - 1).cast("int"))


# -- T12 / T13 ----------------------------------------------------------------------

def words(text: Column) -> Column:
    """Lower-cased whitespace tokens (empty tokens removed)."""
    return F.filter(F.split(F.lower(text), f"{WS}+"), lambda w: w != "")


def build_vocab(df: DataFrame, text_col: str = "text", k: int = 20000, first_id: int = 2) -> DataFrame:
    """The k most frequent words → ids from ``first_id`` (0 = pad, 1 = unknown).

    Word counts are a hash aggregate with map-side combine; the global top-k
    is a per-partition top-k merged on one task (k rows), and only those k
    rows are numbered.  Ties: word ascending.
    """
    counts = (df.select(F.explode(words(F.col(text_col))).alias("word"))
              .groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    top = counts.orderBy(F.col("n").desc(), F.col("word")).limit(k)
    w = Window.orderBy(F.col("n").desc(), F.col("word"))
    return top.select("word", (F.row_number().over(w) + first_id - 1).alias("id"), "n")


def encode_tokens(df: DataFrame, vocab: DataFrame, text_col: str = "text", out: str = "token_ids",
                  key: str = "doc_id", unknown_id: int = 1) -> DataFrame:
    """(key, out) — text → list of word ids in text order (unknown → 1, no
    words → empty list); ``key`` names a document.

    Tokens leave the scan with their position and are looked up before anything
    moves; only (key, position, id) is shuffled, once, to be put together per
    document.  The vocabulary is broadcast if its size allows.
    """
    toks = df.select(key, F.posexplode_outer(words(F.col(text_col))).alias("pos", "word"))
    v = checked_broadcast(vocab.select("word", F.col("id").cast("int").alias("id")))
    j = toks.join(v, "word", "left").select(key, "pos", F.coalesce("id", F.lit(unknown_id)).alias("id"))
    token = F.when(F.col("pos").isNotNull(), F.struct("pos", "id"))  # an empty text has one row without a position
    per_doc = j.groupBy(key).agg(F.sort_array(F.collect_list(token)).alias("_t"))
    return per_doc.select(key, F.col("_t.id").alias(out))


__all__ = [n for n in dir() if not n.startswith("_") and n != "string"]
