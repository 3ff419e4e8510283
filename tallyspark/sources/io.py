"""Readers and writers.

Schemas are declared, never inferred; column aliases are resolved once at
read time (case-insensitively) and nothing downstream guesses.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyspark.functions.codes import METRIC_ROWS, PRED_ALIASES, RUN_FILE_PREFIX



def canonical_columns(columns: list[str], aliases: dict[str, list[str]]) -> dict[str, str]:
    """canonical name → column of ``columns``.

    Every accepted name, folded to lower case, belongs to one canonical name, so
    a column says itself what it is.  A column spelled as the canonical name or as
    an accepted one settles it; two columns that claim one name otherwise raise.
    """
    owner = {name.casefold(): canon for canon, names in aliases.items() for name in names}
    claims: dict[str, list[str]] = {}
    for column in columns:
        if (canon := owner.get(column.casefold())) is not None:
            claims.setdefault(canon, []).append(column)
    for canon, found in claims.items():
        if len(found) > 1:
            exact = [c for c in found if c in aliases[canon]]
            if len(exact) != 1:
                raise ValueError(f"columns {found} all claim {canon!r}")
            claims[canon] = exact
    return {canon: found[0] for canon, found in claims.items()}


def project_aliases(df: DataFrame, aliases: dict[str, list[str]], types: dict[str, str] | None = None,
                    source: str = "input") -> DataFrame:
    """Rename aliased columns to canonical names; raise when one is missing."""
    types = types or {}
    found = canonical_columns(df.columns, aliases)
    if missing := [c for c in aliases if c not in found]:
        raise ValueError(f"{source}: missing column(s) {missing}; found {df.columns}")
    return df.select(*[(F.col(f"`{found[c]}`").cast(types[c]) if c in types else F.col(f"`{found[c]}`")).alias(c)
                       for c in aliases])


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, **options) -> DataFrame:
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load(path)


def read_cases(spark: SparkSession, path: str, columns: dict[str, str | list[str]],
               require: list[str] | None = None, types: dict[str, str] | None = None,
               fmt: str = "parquet", **options) -> DataFrame:
    """Load a case table, check/rename columns, drop rows null in ``require``."""
    df = read_table(spark, path, fmt, **options)
    aliases = {k: (v if isinstance(v, list) else [v]) for k, v in columns.items()}
    out = project_aliases(df, aliases, types, path)
    return out.na.drop(subset=require) if require else out


def read_vehicles(spark: SparkSession, path: str, columns: dict[str, str | list[str]],
                  fmt: str = "parquet", **options) -> DataFrame:
    """Load a vehicle table; vehicle numbers become INT (never '5.0')."""
    df = read_table(spark, path, fmt, **options)
    aliases = {k: (v if isinstance(v, list) else [v]) for k, v in columns.items()}
    types = {"caseid": "bigint", "vehno": "int", "crashcat": "int", "crashtype": "int"}
    return project_aliases(df, aliases, {k: t for k, t in types.items() if k in aliases}, path)


YEAR_FOLDER = r"_(\d{4})_CSV_files"


def read_yearly_csv(spark: SparkSession, root: str, table: str, schema, year_pattern: str = YEAR_FOLDER,
                    **options) -> DataFrame:
    """S3: ``<root>/<prefix>_<year>_CSV_files/<TABLE>.csv`` for every year
    (extension in any case: ``.CSV`` up to 2019, ``.csv`` after), with a
    header row and CRLF or LF line ends, as one table plus ``year``.

    One scan over all years (a path glob); the year comes from each row's
    file path.  A ``<TABLE>.csv`` entry may also be a folder of part files.
    """
    glob = f"{root.rstrip('/')}/*_CSV_files/{table}.[cC][sS][vV]"
    df = spark.read.schema(schema).options(header="true", mode="FAILFAST", **options).csv(glob)
    year = F.regexp_extract(F.input_file_name(), year_pattern, 1).cast("int")
    return df.select(year.alias("year"), *[F.col(f"`{c}`") for c in schema.fieldNames()])


def is_metric_row(summary: Column, gt: Column, pred: Column) -> Column:
    """Rows that a scorer wrote below its predictions: exactly one of the fixed
    markers, with text instead of a number in a label column."""
    number = r"^\s*-?\d+(\.\d+)?\s*$"
    text = ~F.coalesce(gt.rlike(number), F.lit(True)) | ~F.coalesce(pred.rlike(number), F.lit(True))
    return F.coalesce(summary.isin(METRIC_ROWS), F.lit(False)) & text


def read_prediction_runs(spark: SparkSession, paths: list[str], fmt: str = "parquet",
                         aliases: dict[str, list[str]] | None = None, unique: list[str] | None = None) -> DataFrame:
    """Prediction files → one long table (summary, gt, pred, file).

    A path may be a file, a folder or a glob.  Files are grouped by their
    columns, read from one footer each, so thousands of runs are a few scans
    and not a union of thousands.  Labels are trimmed text (normalise with C1).  Metric rows
    (see :func:`is_metric_row`) are left out; narratives that merely begin
    alike stay.  With ``unique`` a repeated key raises.
    """
    aliases = aliases or PRED_ALIASES
    groups: dict[tuple, list[str]] = {}
    for path in expand(spark, paths):
        groups.setdefault(tuple(read_table(spark, path, fmt).dtypes), []).append(path)
    parts = []
    for same in groups.values():
        df = spark.read.format(fmt).load(same).withColumn("_file", F.input_file_name())
        cols = project_aliases(df, {**aliases, "file": ["_file"]},
                               {"summary": "string", "gt": "string", "pred": "string"}, same[0])
        parts.append(cols.withColumns({c: F.trim(c) for c in ("gt", "pred")}))
    out = reduce(DataFrame.unionByName, parts).where(~is_metric_row(F.col("summary"), F.col("gt"), F.col("pred")))
    if unique:
        assert_unique(out, unique, "prediction runs")
    return out


def expand(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that globs stand for, in order; a path that matches nothing raises."""
    jvm = spark.sparkContext._jvm
    out = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        if not found:
            raise FileNotFoundError(p)
        out += sorted(f.getPath().toString() for f in found)
    return out


def file_stem(path: Column) -> Column:
    """A path's last part without its extension.  The path is cut at its last
    slash: a pattern tried from each of its characters takes time in their square."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def parent_folder(path: Column) -> Column:
    """The name of the folder that a path's last part is in ('' without one)."""
    return F.when(path.contains("/"), F.substring_index(F.substring_index(path, "/", -2), "/", 1)).when(
        path.isNotNull(), F.lit(""))


def with_run_tag(df: DataFrame, file_col: str = "file", prefix: str = RUN_FILE_PREFIX) -> DataFrame:
    """Model key and run id from a file name.

    Stem = name without folder and extension; the prefix is removed; a
    trailing ``-<digits>`` is the run id (else -1) and the rest the model.
    """
    stem = file_stem(F.col(file_col))
    name = F.regexp_replace(stem, "^" + prefix, "")
    run = F.regexp_extract(name, r"-(\d+)$", 1)
    return df.withColumn("model_key", F.regexp_replace(name, r"-(\d+)$", "")) \
             .withColumn("run_id", F.when(run != "", run.cast("bigint")).otherwise(F.lit(-1)))


def model_tag_by_prefix(df: DataFrame, file_col: str = "file", drop: int = 2) -> DataFrame:
    """Cross-model reader rule: the model tag is the file stem minus its
    first ``drop`` characters (a sort prefix)."""
    stem = file_stem(F.col(file_col))
    return df.withColumn("model_tag", F.substring(stem, drop + 1, 1 << 20))


def profile_tables(tables: dict[str, DataFrame], exact: bool = True) -> DataFrame:
    """One row per table × column: rows, nulls, distinct non-null values.

    Exact distinct counts take one aggregate per column over a scan that reads
    that column only, so no row is multiplied by the number of columns; counts
    of rows and nulls come along.  ``exact=False`` uses HyperLogLog sketches (one
    pass per table, ~1 % error).  Maps, which Spark cannot group, count as text.
    """
    parts = []
    for name, df in tables.items():
        for i, (c, kind) in enumerate(df.dtypes):
            v = F.col(f"`{c}`")
            v = F.to_json(v) if kind.startswith("map") else v
            parts.append(df.select(v.alias("v")).agg(
                F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("v").isNull()).alias("n_null"),
                (F.count_distinct("v") if exact else F.approx_count_distinct("v", 0.01)).alias("n_distinct")).select(
                F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.lit(i).alias("ordinal"),
                "n_rows", "n_null", "n_distinct"))
    return reduce(DataFrame.unionByName, parts)


def write_report(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                 mode: str = "overwrite") -> None:
    """Write a result table (CSV with header, or Parquet), optionally partitioned."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", "true")
    w.format(fmt).save(path)


def append_scored(df: DataFrame, path: str, fmt: str = "parquet", batch_col: str | None = None) -> None:
    """Add a scored batch to a result table; never a half-written file.

    Each write is one job under the output committer (all-or-nothing).
    With ``batch_col`` the table is partitioned by batch and written with
    dynamic partition overwrite, so re-running a batch (after a failure)
    replaces that batch instead of appending it twice.
    """
    if batch_col is None:
        df.write.mode("append").format(fmt).save(path)
        return
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(batch_col).format(fmt).save(path))


def _content_id(rows: DataFrame) -> str:
    """An id of the rows as a multiset, in any order: their number and two sums
    of hashes of each row (columns by name)."""
    cols = sorted(rows.columns)
    row = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    sums = [F.sum(F.xxhash64(F.lit(salt), row).cast("decimal(38,0)")) for salt in (1, 2)]
    n, a, b = rows.agg(F.count(F.lit(1)), *sums).first()
    return "-".join(f"{int(x or 0) & (1 << 64) - 1:x}" for x in (n, a, b))


def append_once(df: DataFrame, path: str, batch_id: str | None = None) -> str:
    """Append a batch to a result table exactly once; returns its id.

    A batch is a folder ``batch=<id>`` of Parquet files that counts from the moment
    its commit marker (``_SUCCESS``) is there, so the ledger of batches is committed with the data: a
    replay of a committed batch changes nothing, one that failed half-way is
    written anew, and no earlier file is read or rewritten.

    Without ``batch_id`` the id is taken from the rows themselves: appending the
    very same rows again is a replay.  They are then written once to a folder aside, and moved
    into place by one rename.  Give ids where equal batches are to count twice.
    Two writers may not write the same batch at the same time.
    """
    spark = df.sparkSession
    if batch_id is not None and not re.fullmatch(r"[A-Za-z0-9_.-]+", batch_id):
        raise ValueError(f"batch_id {batch_id!r} must be of letters, digits and _.-")
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if batch_id is not None:
        folder = f"{path}/batch={batch_id}"
        if not fs.exists(jvm.Path(f"{folder}/_SUCCESS")):
            df.write.mode("overwrite").parquet(folder)
        return batch_id
    aside = f"{path}/_aside/{uuid.uuid4().hex}"
    df.write.parquet(aside)
    batch_id = _content_id(spark.read.schema(df.schema).parquet(aside))
    folder = jvm.Path(f"{path}/batch={batch_id}")
    if fs.exists(jvm.Path(f"{path}/batch={batch_id}/_SUCCESS")):
        fs.delete(jvm.Path(aside), True)
        return batch_id
    fs.delete(folder, True)  # what a failed attempt left
    if not fs.rename(jvm.Path(aside), folder):
        raise OSError(f"could not move {aside} to {folder}")
    return batch_id


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all committed batches, with their batch id in ``batch``."""
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    marks = fs.globStatus(jvm.Path(f"{path}/batch=*/_SUCCESS"))
    if not len(marks):
        raise FileNotFoundError(f"no committed batch under {path}")
    folders = [m.getPath().getParent().toString() for m in marks]
    ids = spark.read.option("basePath", path).option("mergeSchema", "true").parquet(*folders)
    return ids.withColumn("batch", F.col("batch").cast("string"))


def head_n(df: DataFrame, order: list[str], n: int, by: list[str] | None = None) -> DataFrame:
    """First ``n`` rows (per group ``by``) in the declared order.

    Without groups: a top-k in two steps (see N6).  With groups:
    ``row_number() <= n``, which Spark plans with a per-partition group
    limit before the shuffle, so a hot group ships at most n rows per task.
    """
    if not by:
        from tallyspark.operators.sample import limit_sweep
        return limit_sweep(df, order, [n]).drop("size", "pos")
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def assert_unique(df: DataFrame, keys: list[str], what: str = "rows") -> None:
    """Raise if any key repeats (one aggregate; stops at the first duplicate)."""
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).limit(1).collect()
    if dup:
        raise ValueError(f"{what}: key {keys} is not unique, e.g. {dup[0].asDict()}")
