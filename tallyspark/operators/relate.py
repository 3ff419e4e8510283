"""Relational preparation: vehicle fan-out, truth lookups, eligibility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.codes import CRASHCAT_NAMES, CRASHCAT_UNKNOWN
from tallyspark.functions.joins import checked_broadcast


def first_per_key(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """First row per key in ``order`` (ties broken by the values themselves).

    An aggregate (``min`` of one struct), not a window: it combines map-side, so a hot
    key ships one row per map task instead of all its rows.
    """
    # the values end the ordering, so the least ordering holds them already
    ordered = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c).alias(c) for c in values])
    return df.groupBy(*keys).agg(F.min(ordered).alias("_first")).select(*keys, *[F.col(f"_first.{v}").alias(v) for v in values])


def explode_vehicles(cases: DataFrame, count_col: str = "vehicles", out: str = "vehno") -> DataFrame:
    """One row per vehicle number 1..count (no rows when count < 1)."""
    seq = F.when(F.col(count_col) >= 1, F.sequence(F.lit(1), F.col(count_col).cast("int")))
    return cases.select("*", F.explode(seq).alias(out))


#: Keys asked for up to which truth rows of other keys are dropped before they are reduced.
ASKED_KEYS = 500_000


def lookup_truth(df: DataFrame, gv: DataFrame, order: list[str], keys: tuple[str, str] = ("caseid", "vehno"),
                 values: tuple[str, ...] = ("crashcat", "crashconf", "crashtype"),
                 key_cast: str | None = None) -> DataFrame:
    """Left lookup of the first matching truth row per key (null if absent).

    ``order`` declares "first" and must be given (an empty list: by the values);
    every row of ``df`` comes back once, however often the truth repeats a key.
    The truth side is reduced with :func:`first_per_key`, whose output is already
    hash-partitioned on the keys, so only ``df`` is shuffled for the join.  If ``df``
    asks for few keys, only their truth rows are reduced.
    ``key_cast="string"`` compares keys as text (R3).
    """
    keys = list(keys)
    values = list(values)
    if key_cast:
        df = df.select(*[F.col(c).cast(key_cast).alias(c) if c in keys else F.col(c) for c in df.columns])
        gv = gv.select(*[F.col(c).cast(key_cast).alias(c) if c in keys else F.col(c) for c in gv.columns])
    asked = df.select(*keys).distinct()
    if asked.limit(ASKED_KEYS + 1).count() <= ASKED_KEYS:
        gv = gv.join(F.broadcast(asked), keys, "left_semi")
    return df.join(first_per_key(gv, keys, order, values), keys, "left")


def vehicle_examples(cases: DataFrame, gv: DataFrame, case_order: list[str],
                     text_col: str = "summary", label_col: str = "crashtype") -> DataFrame:
    """Vehicle ⋈ first matching case by ``case_order`` (inner) → focus text +
    label, nulls dropped."""
    from tallyspark.operators.text import focus_vehicle

    first_case = first_per_key(cases, ["caseid"], case_order, [text_col])
    joined = gv.join(first_case, "caseid", "inner")
    out = focus_vehicle(joined, text_col=text_col, vehno_col="vehno", out=text_col)
    return out.select("caseid", "vehno", text_col, label_col).na.drop(subset=[text_col, label_col])


#: Checks of R5 in order; each task asks for some of them.
CHECKS = ("missing_category", "unknown_category", "unknown_configuration", "missing_label")


def eligibility(df: DataFrame, codebook: DataFrame, checks: tuple[str, ...] = CHECKS,
                label: str = "crashtype") -> DataFrame:
    """Tag each vehicle with why it is unusable (``reason`` null = kept).

    ``checks``, in this order: missing category, unknown category (9),
    configuration not in the codebook, missing label.
    """
    known = checked_broadcast(codebook.select(F.col("conf").alias("_conf"), F.lit(True).alias("_known")).distinct())
    j = df.join(known, F.col("crashconf") == F.col("_conf"), "left")
    fails = {"missing_category": F.col("crashcat").isNull(), "unknown_category": F.col("crashcat") == CRASHCAT_UNKNOWN,
             "unknown_configuration": F.col("_known").isNull(), "missing_label": F.col(label).isNull()}
    reason = F.coalesce(*[F.when(fails[c], F.lit(c)) for c in CHECKS if c in checks])
    return j.withColumn("reason", reason).drop("_conf", "_known")


def eligible(df: DataFrame, codebook: DataFrame, checks: tuple[str, ...] = CHECKS, label: str = "crashtype") -> DataFrame:
    return eligibility(df, codebook, checks, label).where(F.col("reason").isNull()).drop("reason")


def eligibility_reasons(df: DataFrame, codebook: DataFrame) -> DataFrame:
    tagged = eligibility(df, codebook)
    return (tagged.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason"))
            .agg(F.count(F.lit(1)).alias("n")))


def category_codebook(spark) -> DataFrame:
    rows = [(k, v) for k, v in CRASHCAT_NAMES.items()]
    return spark.createDataFrame(rows, "crashcat int, category_text string")


def with_category_options(df: DataFrame, cat_codebook: DataFrame) -> DataFrame:
    """Attach the category text by crash category."""
    return df.join(checked_broadcast(cat_codebook), "crashcat", "left")


def configuration_options(options: DataFrame, key: str = "category") -> DataFrame:
    """(key, option_text, note) from rows (key, conf, meaning, remark): the
    letters that a category allows, a line each in letter order, and the remarks
    of those that have one.  Codebook rows only (bounded by the code space)."""
    listed = F.sort_array(F.collect_list(F.struct("conf", "meaning", "remark")))
    per = options.where("conf is not null").groupBy(key).agg(listed.alias("_o"))
    line = F.transform("_o", lambda o: F.concat(o["conf"], F.lit(": "), F.coalesce(o["meaning"], F.lit(""))))
    notes = F.transform(F.filter("_o", lambda o: o["remark"].isNotNull()),
                        lambda o: F.concat(F.lit("Note on "), o["conf"], F.lit(": "), o["remark"]))
    return per.select(key, F.array_join(line, "\n").alias("option_text"), F.array_join(notes, "\n").alias("note"))


def truth_list(gv: DataFrame) -> DataFrame:
    """All vehicles of a case, one row each, with their position (by vehicle
    number) and the case's vehicle count.

    Kept long (no per-case array): rows are numbered by
    :func:`row_number_within`, so a huge case is neither one value nor one task.
    """
    from tallyspark.operators.ranking import row_number_within
    return row_number_within(gv, ["caseid"], ["vehno"], "pos", total="n_vehicles")


def single_vehicle_detail(cases: DataFrame, gv: DataFrame, pred: DataFrame, codebook: DataFrame) -> DataFrame:
    """Cases with exactly one vehicle → truth tuple, predicted type, correct
    0/1.  Vehicles without a category, of an unknown one, or of a configuration
    that the codebook lacks are left out, as are those without a prediction."""
    one = cases.where(F.col("vehicles") == 1).select("caseid").distinct()
    t = eligible(gv.where(F.col("vehno") == 1), codebook, CHECKS[:3]).select(
        "caseid", F.col("crashcat").alias("gt_cat"), F.col("crashconf").alias("gt_conf"),
        F.col("crashtype").alias("gt_type"))
    p = first_per_key(pred.where(F.col("vehno") == 1), ["caseid"], [], ["crashcat", "crashconf", "crashtype"]).select(
        "caseid", F.col("crashtype").alias("pred_type"))
    j = one.join(t, "caseid").join(p, "caseid")
    return j.select("caseid", "gt_cat", "gt_conf", "gt_type", "pred_type",
                    F.coalesce((F.col("pred_type") == F.col("gt_type")).cast("int"), F.lit(0)).alias("correct"))
