"""Registered source/sink queries (S1–S9), batch prediction (T5) and
incremental scoring (X1).

Queries that exercise a writer first write data Spark derives from the
driver tables into a fresh folder under ``spark.checkpoint.dir`` (shared
storage on a cluster), then read it back.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions.codes import METRIC_ROWS, RUN_FILE_PREFIX
from tallyspark.functions.hashing import hash32, sql_hash32
from tallyspark.operators import metrics as M
from tallyspark.plans.queries_agree import cross_long
from tallyspark.plans.registry import register
from tallyspark.plans.sqlkit import r6
from tallyspark.session import scratch_path
from tallyspark.sources import io as IO
from tallyspark.sources.fixtures import MODELS, RUNS, Views, with_views


@register("read_cases", sql="SELECT doc_id AS caseid, text AS summary FROM documents "
                            "WHERE doc_id IS NOT NULL AND text IS NOT NULL")
def q_read_cases(spark, sf_dir):
    return IO.read_cases(spark, f"{sf_dir}/documents.parquet", {"caseid": ["CASEID", "doc_id"],
                         "summary": ["SUMMARY", "text"]}, require=["caseid", "summary"],
                         types={"caseid": "bigint", "summary": "string"})


@register("read_vehicles", sql="SELECT l_orderkey AS caseid, CAST(l_linenumber AS INTEGER) AS vehno, "
                               "CAST(l_suppkey AS INTEGER) AS crashcat, l_returnflag AS crashconf, "
                               "CAST(l_partkey AS INTEGER) AS crashtype FROM lineitem")
def q_read_vehicles(spark, sf_dir):
    return IO.read_vehicles(spark, f"{sf_dir}/lineitem.parquet", {
        "caseid": ["CASEID", "l_orderkey"], "vehno": ["VEHNO", "l_linenumber"], "crashcat": ["CRASHCAT", "l_suppkey"],
        "crashconf": ["CRASHCONF", "l_returnflag"], "crashtype": ["CRASHTYPE", "l_partkey"]})


EVENT_CSV_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()),
    T.StructField("ts", T.TimestampNTZType()), T.StructField("props", T.StringType())])


def stored(df, name: str, by: str):
    """``df`` written once, a folder per value of ``by``, and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(by).parquet(path)
    return df.sparkSession.read.parquet(path)


YEARS = list(range(2017, 2024))
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


@register("read_yearly_csv", sql=(
    f"SELECT CAST(2017 + {sql_hash32('event_id', repr('year'))} % 7 AS INTEGER) AS year, event_id, user_id, "
    "event_type, value, ts, props FROM events"),
    note="events written as one CSV folder per year (.CSV up to 2019, .csv after), read back in one scan")
def q_read_yearly_csv(spark, sf_dir):
    root = scratch_path(spark, "yearly-csv")
    ev = stored(Views(spark, sf_dir).table("events").select(
        (2017 + hash32("event_id", "year") % 7).cast("int").alias("year"), "event_id", "user_id", "event_type", "value",
        "ts", "props"), "yearly-in", "year")
    for y in YEARS:
        ext = "CSV" if y <= 2019 else "csv"
        (ev.where(F.col("year") == y).drop("year").write.mode("overwrite").option("header", "true")
         .option("timestampFormat", MICROS).option("timestampNTZFormat", MICROS).option("lineSep", "\r\n").csv(f"{root}/SURVEY_{y}_CSV_files/EVENTS.{ext}"))
    return IO.read_yearly_csv(spark, root, "EVENTS", EVENT_CSV_SCHEMA, timestampNTZFormat=MICROS)


# Alias style per model: (summary, label, prediction) column names.
STYLES = {"m1": ("SUMMARY", "MANCOLL", "collision_type"), "m2": ("summary", "label", "pred"),
          "m3": ("Summary", "labels", "output")}


def _write_runs(spark, sf_dir):
    """Each (model, run) as its own Parquet folder with that model's column names."""
    root = scratch_path(spark, "pred-runs")
    p = stored(Views(spark, sf_dir).pred_long, "pred-in", "model")
    # Narratives may begin like a metric row; real ones end each file.
    named = F.when(F.col("sid") % 53 == 0, F.lit("Metrics Road ")).otherwise(F.lit("Case "))
    metric = spark.createDataFrame([(m, "accuracy", "0.9") for m in METRIC_ROWS], "s string, g string, p string")
    for m, _ in MODELS:
        s, g, pr = STYLES[m]
        for r in RUNS:
            (p.where((F.col("model") == m) & (F.col("run") == r))
             .select(F.concat(named, F.col("sid").cast("string")).alias("s"), F.concat(F.lit(" "), F.col("gt")).alias("g"),
                     F.col("pred").cast("string").alias("p")).unionByName(metric).toDF(s, g, pr)
             .write.mode("overwrite").parquet(f"{root}/{RUN_FILE_PREFIX}{m}-{r}"))
    return [f"{root}/{RUN_FILE_PREFIX}m1-*", f"{root}/{RUN_FILE_PREFIX}m2-*", *(f"{root}/{RUN_FILE_PREFIX}m3-{r}" for r in RUNS)]


def _runs_folder_tag(df):
    # Part files sit in a folder named after the run; tag from the folder.
    return IO.with_run_tag(df.withColumn("file", IO.parent_folder(F.col("file"))))


@register("read_prediction_runs", sql=with_views("pred_long",
    "SELECT CASE WHEN sid % 53 = 0 THEN 'Metrics Road ' ELSE 'Case ' END || CAST(sid AS VARCHAR) AS summary, CAST(gt AS VARCHAR) AS gt, CAST(pred AS VARCHAR) AS pred, "
    "model AS model_key, CAST(run AS BIGINT) AS run_id FROM pred_long"))
def q_read_prediction_runs(spark, sf_dir):
    df = _runs_folder_tag(IO.read_prediction_runs(spark, _write_runs(spark, sf_dir)))
    IO.assert_unique(df, ["model_key", "run_id", "summary"], "prediction runs")
    return df.select("summary", "gt", "pred", "model_key", "run_id")


_TAG_SQL = ("CASE WHEN model = 'm3' THEN model || '_final' ELSE '" + RUN_FILE_PREFIX + "' || model || '-' || "
            "CAST(run AS VARCHAR) END || '.xlsx'")


@register("parse_run_tag", sql=with_views("pred_long",
    f"SELECT sid, model, run, file, regexp_replace(regexp_replace(regexp_replace(file, '\\.[^.]*$', ''), "
    "'^" + RUN_FILE_PREFIX + "', ''), '-(\\d+)$', '') AS model_key, "
    "CASE WHEN regexp_extract(regexp_replace(file, '\\.[^.]*$', ''), '-(\\d+)$', 1) <> '' THEN "
    "CAST(regexp_extract(regexp_replace(file, '\\.[^.]*$', ''), '-(\\d+)$', 1) AS BIGINT) ELSE -1 END AS run_id "
    f"FROM (SELECT sid, model, run, {_TAG_SQL} AS file FROM pred_long)"))
def q_parse_run_tag(spark, sf_dir):
    p = Views(spark, sf_dir).pred_long
    file = (F.concat(F.when(F.col("model") == "m3", F.concat(F.col("model"), F.lit("_final")))
                     .otherwise(F.concat(F.lit(RUN_FILE_PREFIX), F.col("model"), F.lit("-"),
                                         F.col("run").cast("string"))), F.lit(".xlsx")))
    return IO.with_run_tag(p.select("sid", "model", "run", file.alias("file")))


@register("model_tag_by_prefix", sql=with_views("pred_long",
    "SELECT sid, model, run, '0' || CAST(run AS VARCHAR) || model || '_final.xlsx' AS file, model || '_final' AS model_tag "
    "FROM pred_long"))
def q_model_tag_by_prefix(spark, sf_dir):
    p = Views(spark, sf_dir).pred_long
    file = F.concat(F.lit("0"), F.col("run").cast("string"), "model", F.lit("_final.xlsx"))
    return IO.model_tag_by_prefix(p.select("sid", "model", "run", file.alias("file")))


PROFILED = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
            "pages", "benchmark", "labels", "conversations"]


def _profile_sql() -> str:
    # Nulls become chr(0) so that UNPIVOT keeps them.
    parts = [f"SELECT '{t}' AS table_name, column_name, CAST(count(*) AS BIGINT) AS n_rows, "
             f"CAST(count(*) FILTER (WHERE v = chr(0)) AS BIGINT) AS n_null, "
             f"CAST(count(DISTINCT v) FILTER (WHERE v <> chr(0)) AS BIGINT) AS n_distinct "
             f"FROM (UNPIVOT (SELECT coalesce(COLUMNS(*)::VARCHAR, chr(0)) FROM {t}) ON COLUMNS(*) "
             f"INTO NAME column_name VALUE v) GROUP BY column_name" for t in PROFILED]
    return " UNION ALL ".join(parts)


@register("profile_tables", sql=_profile_sql())
def q_profile_tables(spark, sf_dir):
    v = Views(spark, sf_dir)
    return IO.profile_tables({t: v.table(t) for t in PROFILED}).drop("ordinal")


def _write_report_sql() -> str:
    from tallyspark.plans.registry import REGISTRY
    a10 = REGISTRY["self_consistency"].sql
    return a10.replace("SELECT s.model, nr.num_runs,", "SELECT s.model, nr.num_runs, "
                       "(SELECT count(DISTINCT o_orderkey) FROM orders) AS merged_rows,", 1)


@register("write_report", sql=_write_report_sql(), note="writes CSV + partitioned Parquet, reads both back")
def q_write_report(spark, sf_dir):
    from tallyspark.operators import agree
    root = scratch_path(spark, "report")
    summary = agree.self_consistency(Views(spark, sf_dir).pred_long, ["sid"], "pred", "run", "gt", by=["model"])
    IO.write_report(summary, f"{root}/summary_self_consistency", "csv")
    wide = agree.merge_predictions(cross_long(spark, sf_dir), ["sid"], "rater", "pred", keep=["gt"])
    IO.write_report(wide.withColumn("gt_class", F.col("gt")), f"{root}/merged_predictions", "parquet",
                    partition_by=["gt_class"])
    back = spark.read.option("header", "true").schema(summary.schema).csv(f"{root}/summary_self_consistency")
    merged = spark.read.parquet(f"{root}/merged_predictions").select(F.count(F.lit(1))).scalar()
    return back.withColumn("merged_rows", merged)


@register("append_scored", sql=with_views("pred_long",
    f"SELECT model, run, count(*) AS n, {r6('avg(CAST(gt = pred AS DOUBLE))')} AS accuracy FROM pred_long "
    "WHERE gt IS NOT NULL AND pred IS NOT NULL GROUP BY ALL"),
    note="one append per run; the table read back holds every run")
def q_append_scored(spark, sf_dir):
    path = scratch_path(spark, "scored")
    p = stored(Views(spark, sf_dir).pred_long, "scored-in", "run").withColumn("run", F.col("run").cast("int"))
    for r in RUNS:  # one scored batch per run; run 1 is written twice, as a retry would
        IO.append_scored(M.accuracy(p.where(F.col("run") == r), "gt", "pred", ["model", "run"]), path, batch_col="run")
    IO.append_scored(M.accuracy(p.where(F.col("run") == RUNS[0]), "gt", "pred", ["model", "run"]), path,
                     batch_col="run")
    return spark.read.parquet(path).withColumn("run", F.col("run").cast("int"))


@register("append_scored_ledger", sql=with_views("pred_long",
    f"SELECT model, run, count(*) AS n, {r6('avg(CAST(gt = pred AS DOUBLE))')} AS accuracy FROM pred_long "
    "WHERE gt IS NOT NULL AND pred IS NOT NULL GROUP BY ALL"),
    note="every run appended without naming a batch, one of them again; a named batch twice")
def q_append_scored_ledger(spark, sf_dir):
    path = scratch_path(spark, "ledger")
    p = stored(Views(spark, sf_dir).pred_long, "scored-in", "run").withColumn("run", F.col("run").cast("int"))
    scored = {r: M.accuracy(p.where(F.col("run") == r), "gt", "pred", ["model", "run"]) for r in RUNS}
    for r in [*RUNS[1:], RUNS[1]]:
        IO.append_once(scored[r], path)
    for _ in range(2):
        IO.append_once(scored[RUNS[0]], path, batch_id=f"run-{RUNS[0]}")
    return IO.read_appended(spark, path).drop("batch")


@register("head_n_per_file", sql=with_views("pred_long",
    "SELECT sid, model, run, gt, pred FROM (SELECT *, row_number() OVER (PARTITION BY model, run ORDER BY sid) AS rn "
    "FROM pred_long) WHERE rn <= 200"))
def q_head_n_per_file(spark, sf_dir):
    return IO.head_n(Views(spark, sf_dir).pred_long, ["sid"], 200, by=["model", "run"])
