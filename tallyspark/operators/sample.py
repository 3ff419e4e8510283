"""Exact, reproducible sampling, label noise and splits.

Row order is a seeded hash of a unique row key: ``(H(key, seed), key)``.
"The first k rows" is found without sorting the table, without moving its rows
and without a window over a whole group (a hot class or the whole table would
land on one task):

1. bucket = top ``BUCKET_BITS`` bits of the hash; count rows per
   (group, bucket) — a hash aggregate with map-side combine, at most
   groups × 2^BUCKET_BITS rows;
2. running counts per group over its buckets (a window over the small
   count table) give the one bucket in which each cut falls, and how many of
   its rows are still in;
3. only that bucket's keys are ranked, which gives the cut itself: the hash
   and key of the last row in (one row per group and cut);
4. a row is in if its hash and key are not above the cut: a comparison
   against a broadcast row.

The result is identical to ``row_number() over (partition by group order by
hash, key)`` — which is what the SQL oracles compute.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyspark.functions.hashing import hash32
from tallyspark.functions.joins import checked_broadcast, join_keys

BUCKET_BITS = 18
SWEEP_DEALS = 64


def row_key(cols: list[str]) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in cols])


def order_hash(key_cols: list[str], seed) -> Column:
    return hash32(row_key(key_cols), f"seed{seed}")


def rank_flags(df: DataFrame, key_cols: list[str], seed, cuts, group_cols: list[str] | None = None,
               bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """Add ``_in_<i>`` = (rank within group ≤ cut_i) for each cut.

    ``cuts`` is a callable ``(n_group: Column, counts_df) -> list[Column]``
    returning the cut ranks per group (they may depend on the group size),
    or a DataFrame with columns group_cols + ``_cut_<i>`` (per-group cuts).
    Adds ``_h`` (order hash) as a by-product.
    """
    given = list(group_cols or [])
    g = given or ["_g"]
    shift = 32 - bucket_bits
    base = df.withColumn("_h", order_hash(key_cols, seed)).withColumn("_b", F.shiftright("_h", shift))
    if not given:  # 0, but no literal: the broadcast of the cut stays a hash join
        base = base.withColumn("_g", F.shiftright("_h", 32))
    counts = base.groupBy(*g, "_b").agg(F.count(F.lit(1)).alias("_c"))
    wg = Window.partitionBy(*g)
    w = wg.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    cum = (counts.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0)))
           .withColumn("_n", F.sum("_c").over(wg)))
    if callable(cuts):
        cut_cols = cuts(F.col("_n"))
        cum = cum.select("*", *[c.alias(f"_cut_{i}") for i, c in enumerate(cut_cols)])
        k = len(cut_cols)
    else:
        if not given:
            raise ValueError("per-group cuts need group columns; pass a callable otherwise")
        k = len([c for c in cuts.columns if c.startswith("_cut_")])
        cum = join_keys(cum, cuts, g)
    each = F.array(*[F.struct(F.lit(i).alias("_i"), F.col(f"_cut_{i}").cast("long").alias("_cut")) for i in range(k)])
    # the bucket in which a cut falls: one row per group and cut
    edges = (cum.select(*g, "_b", "_before", "_c", F.inline(each))
             .where((F.col("_cut") > F.col("_before")) & (F.col("_cut") <= F.col("_before") + F.col("_c")))
             .select(*g, "_b", "_i", (F.col("_cut") - F.col("_before")).alias("_need")))
    near = join_keys(base.select(*g, "_b", "_h", *[F.col(c).alias(f"_key_{j}") for j, c in enumerate(key_cols)]),
                     F.broadcast(edges) if not given else checked_broadcast(edges), [*g, "_b"])
    place = ["_h", *[f"_key_{j}" for j in range(len(key_cols))]]
    rank = F.row_number().over(Window.partitionBy(*g, "_b", "_i").orderBy(*place))
    last = near.withColumn("_rank", rank).where("_rank = _need")
    limits = last.groupBy(*g).agg(*[F.max(F.when(F.col("_i") == i, F.struct(*place))).alias(f"_last_{i}") for i in range(k)])
    flagged = join_keys(base, F.broadcast(limits) if not given else checked_broadcast(limits), g, "left")
    mine = F.struct("_h", *[F.col(c).alias(f"_key_{j}") for j, c in enumerate(key_cols)])
    flags = [F.coalesce(mine <= F.col(f"_last_{i}"), F.lit(False)).alias(f"_in_{i}") for i in range(k)]
    return flagged.select(*df.columns, "_h", *flags)


def floor_pct(n: Column, pct: int) -> Column:
    """⌊n·pct/100⌋ in exact integer arithmetic."""
    return F.call_function("div", n.cast("long") * F.lit(int(pct)), F.lit(100))


def ceil_pct(n: Column, pct: int) -> Column:
    """⌈n·pct/100⌉ in exact integer arithmetic."""
    return floor_pct(n, pct) + F.when((n * F.lit(int(pct))) % 100 > 0, 1).otherwise(0)


def replacement_label(current: Column, codes: list, key_cols: list[str], seed) -> Column:
    """Uniform pick among the allowed codes other than the current one
    (all codes when the current label is null or not in the list)."""
    arr = F.array(*[F.lit(c) for c in codes])
    others = F.coalesce(F.array_remove(arr, current), arr)
    h = hash32(row_key(key_cols), f"val{seed}")
    return F.element_at(others, (h % F.size(others) + 1).cast("int"))


def inject_label_noise(df: DataFrame, key_cols: list[str], col: str, codes: list, pct: int,
                       seed=0, out: str | None = None) -> DataFrame:
    """Exactly ⌊n·pct/100⌋ rows get a different allowed label."""
    out = out or f"{col}_new"
    flagged = rank_flags(df, key_cols, seed, lambda n: [floor_pct(n, pct)])
    new = F.when(F.col("_in_0"), replacement_label(F.col(col), codes, key_cols, seed)).otherwise(F.col(col))
    return flagged.select(*df.columns, new.cast(df.schema[col].dataType).alias(out),
                          F.col("_in_0").alias("changed"))


def noise_ladder(df: DataFrame, key_cols: list[str], col: str, codes: list, pcts: list[int],
                 seed=0, out: str | None = None) -> DataFrame:
    """N1 at several noise levels from one ranking (levels nest).

    Long output: one row per (level, input row).
    """
    out = out or f"{col}_new"
    flagged = rank_flags(df, key_cols, seed, lambda n: [floor_pct(n, p) for p in pcts])
    rep = replacement_label(F.col(col), codes, key_cols, seed)
    levels = F.array(*[F.struct(F.lit(p).alias("noise_pct"), F.col(f"_in_{i}").alias("_sel"))
                       for i, p in enumerate(pcts)])
    long = flagged.select(*df.columns, rep.alias("_rep"), F.inline(levels))
    new = F.when(F.col("_sel"), F.col("_rep")).otherwise(F.col(col)).cast(df.schema[col].dataType)
    return long.select("noise_pct", *df.columns, new.alias(out), F.col("_sel").alias("changed"))


def random_split(df: DataFrame, key_cols: list[str], test_pct: int, val_pct: int = 0, seed=0) -> DataFrame:
    """Exact nested split — test = ⌈n·test%⌉ rows, then val = ⌈rest·val%⌉
    of the remaining rows, the rest is train."""
    def cuts(n):
        t = ceil_pct(n, test_pct)
        return [t, t + ceil_pct(n - t, val_pct)]
    f = rank_flags(df, key_cols, seed, cuts)
    split = F.when(F.col("_in_0"), "test").when(F.col("_in_1"), "val").otherwise("train")
    return f.select(*df.columns, split.alias("split"))


def stratified_quotas(df: DataFrame, strat: str, test_pct: int) -> DataFrame:
    """Per-class test quota (see :func:`quotas_from_counts`)."""
    return quotas_from_counts(df.groupBy(strat).agg(F.count(F.lit(1)).alias("_nc")), strat, test_pct)


def quotas_from_counts(c: DataFrame, strat: str, test_pct: int) -> DataFrame:
    """Quotas by largest remainder from (strat, _nc): T = ⌈n·test%⌉ rows split
    in proportion to class sizes; the leftover seats go to the largest
    fractional parts (ties: smaller class value).  Classes are few; the
    windows run over the per-class count table only."""
    wall = Window.partitionBy(F.lit(0))
    c = c.withColumn("_n", F.sum("_nc").over(wall))
    c = c.withColumn("_t", ceil_pct(F.col("_n"), test_pct))
    num = F.col("_nc").cast("decimal(19,0)") * F.col("_t").cast("decimal(19,0)")  # 38 digits hold any product
    n = F.col("_n").cast("decimal(19,0)")
    c = c.withColumn("_base", F.call_function("div", num, n)).withColumn("_rem", num % n)
    c = c.withColumn("_left", F.col("_t") - F.sum("_base").over(wall))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("_rem").desc(), F.col(strat).asc_nulls_last())
    c = c.withColumn("_extra", (F.row_number().over(order) <= F.col("_left")).cast("long"))
    return c.select(strat, (F.col("_base") + F.col("_extra")).alias("_cut_0"))


def stratified_split(df: DataFrame, key_cols: list[str], strat: str, test_pct: int, seed=0) -> DataFrame:
    """Test rows per class = its largest-remainder quota, first in hash order."""
    quotas = stratified_quotas(df, strat, test_pct)
    f = rank_flags(df, key_cols, seed, quotas, [strat])
    return f.select(*df.columns, F.when(F.col("_in_0"), "test").otherwise("train").alias("split"))


def class_weights(df: DataFrame, col: str, k: int | None = None) -> DataFrame:
    """w_c = (1/(n_c+1e-9)) / Σ_c' 1/(n_c'+1e-9) · K (K = present classes
    by default).  The window runs over the per-class counts only."""
    c = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    wall = Window.partitionBy(F.lit(0))
    inv = 1.0 / (F.col("n") + F.lit(1e-9))
    kk = F.lit(float(k)) if k is not None else F.count(F.lit(1)).over(wall).cast("double")
    return c.select("label", "n", F.round(inv / F.sum(inv).over(wall) * kk, 6).alias("weight"))


def with_class_weights(df: DataFrame, col: str, out: str = "weight", k: int | None = None) -> DataFrame:
    w = class_weights(df, col, k).select(F.col("label").alias(col), F.col("weight").alias(out))
    return df.join(checked_broadcast(w), col, "left")


def limit_sweep(df: DataFrame, order_cols: list[str], sizes: list[int]) -> DataFrame:
    """Training sets of the first n rows for each n in ``sizes``.

    The first max(n) rows are found in two steps, per deal of partitions and then
    over ``SWEEP_DEALS`` deals, so what one task merges does not grow with the
    number of splits; they are numbered, then fanned out per size.
    """
    most = max(sizes)
    deal = Window.partitionBy("_deal").orderBy(*order_cols)
    few = (df.withColumn("_deal", F.spark_partition_id() % SWEEP_DEALS)
           .withColumn("_rn", F.row_number().over(deal)).where(F.col("_rn") <= most).drop("_deal", "_rn"))
    top = few.orderBy(*order_cols).limit(most)
    numbered = top.withColumn("pos", F.row_number().over(Window.orderBy(*order_cols)))
    fan = numbered.select("*", F.explode(F.array(*[F.lit(s) for s in sizes])).alias("size"))
    return fan.where(F.col("pos") <= F.col("size")).select("size", "pos", *df.columns)
