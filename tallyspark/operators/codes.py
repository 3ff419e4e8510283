"""Label cleaning, encodings and codebooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyspark.functions.codes import INDEX_TO_MANCOLL, SYMBOL_LETTERS
from tallyspark.functions.joins import checked_broadcast
from tallyspark.session import scratch_path


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalise_label(c: Column) -> Column:
    """Canonical label text: trimmed; integral floats lose '.0' ('5.0' → '5')."""
    return F.regexp_replace(_strip(c.cast("string")), r"^(-?\d+)\.0+$", "$1")


def normalise_labels(df: DataFrame, cols: list[str]) -> DataFrame:
    """C1."""
    return df.select(*[normalise_label(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def label_mapping(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct labels → contiguous ids 0..k-1.

    The window runs over the *distinct* labels only (a class set), never
    over the rows.
    """
    labels = df.select(F.col(col).alias("label")).where(F.col("label").isNotNull()).distinct()
    return labels.select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("label_id"))


def label_mapping_ranged(df: DataFrame, col: str, partitions: int | None = None) -> DataFrame:
    """``label_mapping`` for label sets of any size (``label_id`` is a long).

    Distinct labels are range-partitioned and written once with their partition;
    each partition numbers its own and adds the number of labels before it.  No
    task sees more than a partition's labels; one row per partition tells the offsets.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "labels")
    labels = df.select(F.col(col).alias("label")).where(F.col("label").isNotNull()).distinct()
    labels.repartitionByRange(n, "label").withColumn("part", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    every = sizes.agg(F.collect_list(F.struct("part", "n")).alias("all"))  # a row per partition
    before = F.aggregate(F.filter("all", lambda x: x["part"] < F.col("part")), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    offsets = every.select("all", F.explode("all.part").alias("part")).select("part", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("label"))
    return (ranged.join(F.broadcast(offsets), "part")
            .select("label", (F.col("before") + rank - 1).cast("long").alias("label_id")))


def apply_encoding(df: DataFrame, col: str, mapping: DataFrame, on_unseen: str = "raise",
                   out: str = "label_id") -> DataFrame:
    """Map ``col`` through a train-time mapping.

    ``on_unseen``: ``raise`` (fail the job on the first unseen label),
    ``drop`` (inner join) or ``null``.  The mapping is one row per class.
    """
    m = checked_broadcast(mapping.select(F.col("label").alias("_label"), F.col("label_id").alias(out)))
    if on_unseen == "drop":
        return df.join(m, F.col(col) == F.col("_label"), "inner").drop("_label")
    j = df.join(m, F.col(col) == F.col("_label"), "left").drop("_label")
    if on_unseen == "raise":
        bad = F.col(out).isNull() & F.col(col).isNotNull()
        j = j.withColumn(out, F.when(bad, F.raise_error(F.concat(F.lit("unseen label: "), F.col(col).cast("string"))))
                         .otherwise(F.col(out)))
    return j


def encode_labels(df: DataFrame, col: str, out: str = "label_id") -> tuple[DataFrame, DataFrame]:
    """Returns (encoded table, mapping)."""
    mapping = label_mapping(df, col)
    return apply_encoding(df, col, mapping, "null", out), mapping


def remap_codes(df: DataFrame, col: str, mapping: dict | None = None, out: str | None = None) -> DataFrame:
    """C4: class index → original code via a literal map; others unchanged."""
    mapping = mapping or INDEX_TO_MANCOLL
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return df.withColumn(out or col, F.coalesce(F.try_element_at(m, F.col(col)), F.col(col)))


def with_meaning(df: DataFrame, cols: dict[str, str], names: dict) -> DataFrame:
    """Attach class names from a codebook (a literal map: no join needed)."""
    m = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    for col, out in cols.items():
        df = df.withColumn(out, F.try_element_at(m, F.col(col)))
    return df


def codebook_sheet(gv: DataFrame, letters: list[str]) -> DataFrame:
    """Transposed configuration sheet derived from vehicle labels: one row per
    attribute (code_offset, options, class_text), one column per letter.

    Per configuration: offset = lowest crash type rounded down to a multiple
    of 7; options = dict literal of local code → text for each seen type.
    Distinct types per configuration are bounded by the code space (≤ 100).
    """
    per = (gv.where(F.col("crashconf").isNotNull() & F.col("crashtype").isNotNull())
           .groupBy(F.col("crashconf").alias("conf"))
           .agg(F.min("crashtype").alias("lo"), F.sort_array(F.collect_set("crashtype")).alias("types")))
    off = (F.floor(F.col("lo") / 7) * 7).cast("int")
    opts = F.concat(F.lit("{"), F.array_join(F.transform(
        "types", lambda t: F.format_string("%d: 'type %d'", t - off, t)), ",\n    "), F.lit("}"))
    long = per.select("conf", F.inline(F.array(
        F.struct(F.lit("code_offset").alias("attr"), off.cast("string").alias("value")),
        F.struct(F.lit("options").alias("attr"), opts.alias("value")),
        F.struct(F.lit("class_text").alias("attr"), F.concat(F.lit("Configuration "), F.col("conf")).alias("value")))))
    return long.groupBy("attr").pivot("conf", letters).agg(F.max("value"))


def unpivot_codebook(sheet: DataFrame, letters: list[str]) -> DataFrame:
    """Transposed sheet → (conf, code_offset, options, class_text)."""
    present = [c for c in letters if c in sheet.columns]
    long = sheet.unpivot(["attr"], present, "conf", "value").where(F.col("value").isNotNull())
    wide = long.groupBy("conf").pivot("attr", ["code_offset", "options", "class_text"]).agg(F.max("value"))
    return wide.select("conf", F.col("code_offset").cast("int").alias("code_offset"), "options", "class_text")


def parse_options(df: DataFrame, col: str = "options", key: str = "conf") -> tuple[DataFrame, DataFrame]:
    """Dict-literal text → one row per option; malformed → no rows, counted.

    Parsed with the JSON reader in lenient mode (unquoted numeric keys,
    single quotes, backslash escapes).  Returns (options, failures-per-key).
    """
    opts = {"allowUnquotedFieldNames": "true", "allowSingleQuotes": "true",
            "allowBackslashEscapingAnyCharacter": "true", "mode": "PERMISSIVE"}
    parsed = df.select(key, F.from_json(F.col(col), "map<string,string>", opts).alias("_m"))
    rows = parsed.select(key, F.explode("_m").alias("code", "meaning")).select(
        key, F.col("code").cast("int").alias("code"), "meaning")
    failures = parsed.groupBy().agg(F.count(F.when(F.col("_m").isNull(), 1)).alias("n_failed"),
                                    F.count(F.lit(1)).alias("n_total"))
    return rows, failures


def local_symbol(k: Column) -> Column:
    """0..9 → '0'..'9', then 10 → 'A', 11 → 'B', ..."""
    return F.when(k < 10, k.cast("string")).otherwise(F.char(k + 55))


def encode_local(df: DataFrame, codebook: DataFrame, type_col: str = "crashtype",
                 conf_col: str = "crashconf", out: str = "local_code") -> DataFrame:
    """Global crash type → one-symbol local label (broadcast codebook)."""
    cb = checked_broadcast(codebook.select(F.col("conf").alias("_conf"), "code_offset"))
    j = df.join(cb, F.col(conf_col) == F.col("_conf"), "inner").drop("_conf")
    return j.withColumn(out, local_symbol(F.col(type_col) - F.col("code_offset")))


def symbol_number(c: Column, letters: dict | None = None) -> Column:
    """A→10, B→11, C→12, D→13 (anywhere in the text), then the first
    whole-word integer mod 100; null when there is none."""
    letters = letters or SYMBOL_LETTERS
    for ch, num in letters.items():
        c = F.replace(c, F.lit(ch), F.lit(str(num)))
    m = F.regexp_extract(c, r"\b(\d+)\b", 1)
    return F.when(m != "", F.substring(m, -2, 2).cast("int"))


def decode_local(df: DataFrame, codebook: DataFrame, symbol_col: str = "local_code",
                 conf_col: str = "crashconf", out: str = "decoded_type") -> DataFrame:
    """Parsed local number + configuration offset → global crash type."""
    cb = checked_broadcast(codebook.select(F.col("conf").alias("_conf"), F.col("code_offset").alias("_off")))
    j = df.join(cb, F.col(conf_col) == F.col("_conf"), "left").drop("_conf")
    return j.withColumn(out, (symbol_number(F.col(symbol_col)) + F.col("_off")).cast("int")).drop("_off")


def sample_digest(text: Column, label: Column) -> Column:
    """md5(text || '||' || label), nulls read as empty text."""
    return F.md5(F.concat(F.coalesce(text, F.lit("")), F.lit("||"), F.coalesce(label.cast("string"), F.lit(""))))


def sample_hash_id(text: Column, label: Column) -> Column:
    """The first 10 characters of the digest (for display: 40 bits collide
    among some 10^6 samples)."""
    return F.substring(sample_digest(text, label), 1, 10)


def with_sample_id(df: DataFrame, text: str, label: str, by: list[str], order: list[str],
                   out: str = "sample_id") -> DataFrame:
    """Unique sample id when no case id exists: full digest + '#' + occurrence.

    The occurrence number counts equal (text, label) rows within ``by`` (a
    file, i.e. model × run) in the declared ``order``.  A writer that stores
    the same text on every row makes one hash hold a whole file, so the
    numbering uses :func:`row_number_within` (no single task per hash).
    """
    from tallyspark.operators.ranking import row_number_within

    keyed = df.withColumn("_sh", sample_digest(F.col(text), F.col(label)))
    numbered = row_number_within(keyed, by + ["_sh"], order, "_occ")
    return numbered.withColumn(out, F.concat(F.col("_sh"), F.lit("#"), F.col("_occ").cast("string"))) \
                   .drop("_sh", "_occ")
