"""Agreement between raters and between repeated runs.

Input is one **long** table: one row per (sample, rater) with a label, plus
optional grouping columns (``by``, e.g. the model) and a truth column.  Each
operator aggregates on the finest key first (sample × label), with map-side
combine, and only then per sample or per group: a sample or group holding a
third of all rows is pre-aggregated in every map task before it is shuffled,
so no task ever receives a hot key's raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.codes import UNKNOWN_CODE
from tallyspark.functions.joins import join_keys


def _r6(c: Column) -> Column:
    return F.round(c, 6)


def raters_of(long: DataFrame, rater: str) -> list:
    """Distinct rater names (a tiny aggregate; raters are few by nature)."""
    return sorted(r[0] for r in long.select(rater).distinct().collect())


# -- A1 -----------------------------------------------------------------------

def merge_predictions(long: DataFrame, sample: list[str], rater: str, label: str,
                      raters: list | None = None, keep: list[str] | None = None) -> DataFrame:
    """A1: one row per sample, one column per rater (one shuffle, no fold of joins)."""
    keep = keep or []
    raters = raters if raters is not None else raters_of(long, rater)
    # One conditional max per rater: a single code-generated aggregate with
    # map-side combine (a pivot would add two non-codegen aggregation steps).
    cols = [F.max(F.when(F.col(rater) == F.lit(r), F.col(label))).alias(str(r)) for r in raters]
    return long.groupBy(*sample, *keep).agg(*cols)


# -- A2/A3/A4/A11 ---------------------------------------------------------------

def pairwise_from_wide(wide: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """Agreement of every ordered column pair, from one aggregate.

    Each sample's labels are read once per unordered pair of columns, straight
    into a count per (by, pair): nothing per sample is shuffled again, and the
    generated code is as small for 60 raters as for 3.  Output
    ``(by..., rater_a, rater_b, n_both, n_equal, agreement)``; diagonal:
    agreement 1.0, n_both = votes of that rater.  A rater without a vote in a
    group has no cells there.
    """
    by = by or []
    k = len(cols)
    pairs = F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(j).alias("_j")) for i in range(k) for j in range(i, k)])
    labels = F.array(*[F.col(f"`{c}`") for c in cols])
    rows = wide.select(*by, labels.alias("_v"), F.inline(pairs))
    a, b = F.get("_v", F.col("_i")), F.get("_v", F.col("_j"))
    half = rows.groupBy(*by, "_i", "_j").agg(F.count(F.when(a.isNotNull(), b)).alias("n_both"),
                                             F.count_if(a == b).alias("n_equal"))
    # raters × raters rows per group from here on
    both_ways = F.when(F.col("_i") == F.col("_j"), F.array(F.struct("_i", "_j"))).otherwise(F.array(
        F.struct("_i", "_j"), F.struct(F.col("_j").alias("_i"), F.col("_i").alias("_j"))))
    full = half.select(*by, "n_both", "n_equal", F.inline(both_ways))
    own = F.when(F.col("_i") == F.col("_j"), F.col("n_both"))
    full = (full.withColumn("_va", F.max(own).over(Window.partitionBy(*by, "_i")))
            .withColumn("_vb", F.max(own).over(Window.partitionBy(*by, "_j"))).where("_va > 0 and _vb > 0"))
    names = F.array(*[F.lit(str(c)) for c in cols])
    agreement = (F.when(F.col("_i") == F.col("_j"), F.lit(1.0))
                 .when(F.col("n_both") > 0, _r6(F.col("n_equal") / F.col("n_both"))))
    return full.select(*by, F.element_at(names, F.col("_i") + 1).alias("rater_a"),
                       F.element_at(names, F.col("_j") + 1).alias("rater_b"), "n_both", "n_equal",
                       agreement.alias("agreement"))


def pairwise_agreement(long: DataFrame, sample: list[str], rater: str, label: str,
                       by: list[str] | None = None, raters: list | None = None,
                       truth: str | None = None, truth_name: str = "GT") -> DataFrame:
    """A2 (A11 with ``by``; A3 with ``truth``): pairwise exact-match rate."""
    by = by or []
    raters = [str(r) for r in (raters if raters is not None else raters_of(long, rater))]
    keep = [truth] if truth else []
    src = long.withColumn(rater, F.col(rater).cast("string"))
    wide = merge_predictions(src, by + sample, rater, label, raters, keep)
    cols = list(raters)
    if truth:
        wide = wide.withColumn(truth_name, F.col(truth))
        cols.append(truth_name)
    return pairwise_from_wide(wide, cols, by)


def accuracy_vs_gt(pairs_with_gt: DataFrame, truth_name: str = "GT") -> DataFrame:
    """A4: the truth column of A3 → (rater, n_both, accuracy_vs_gt)."""
    return (pairs_with_gt.where((F.col("rater_b") == truth_name) & (F.col("rater_a") != truth_name))
            .select(*[c for c in pairs_with_gt.columns if c not in
                      ("rater_a", "rater_b", "n_both", "n_equal", "agreement")],
                    F.col("rater_a").alias("rater"), "n_both",
                    F.col("agreement").alias("accuracy_vs_gt")))


# -- A5/A6/A7/A12 ----------------------------------------------------------------

def sample_consistency(long: DataFrame, sample: list[str], label: str, truth: str | None = None,
                       by: list[str] | None = None, rounded: bool = True) -> DataFrame:
    """A5 (+ A6 when ``truth`` is given): share of the largest vote group.

    Null when a sample has at most one vote; a sample without any stays, with
    0 votes.  With truth, the truth label is one more vote: it adds one to the
    group of its label (or forms its own).
    """
    keys = (by or []) + sample + ([truth] if truth else [])
    per_label = long.groupBy(*keys, label).agg(F.count(label).alias("_n"))
    return consistency_from_counts(per_label, sample, label, truth, by, "_n", rounded)


def consistency_from_counts(per_label: DataFrame, sample: list[str], label: str, truth: str | None = None,
                            by: list[str] | None = None, n: str = "n", rounded: bool = True) -> DataFrame:
    """A5/A6 from the number ``n`` of votes per sample (with its truth) and label."""
    by = by or []
    rnd = _r6 if rounded else (lambda c: c)
    keys = by + sample + ([truth] if truth else [])
    aggs = [F.sum(n).alias("n_votes"), F.max(n).alias("_top")]
    if truth:
        aggs.append(F.max(F.when(F.col(label) == F.col(truth), F.col(n) + 1)
                          .otherwise(F.col(n))).alias("_top_gt"))
    s = per_label.groupBy(*keys).agg(*aggs)
    out = [*keys, F.col("n_votes").cast("bigint").alias("n_votes"),
           F.when(F.col("n_votes") > 1, rnd(F.col("_top") / F.col("n_votes"))).alias("sample_consistency")]
    if truth:
        tv = F.col("n_votes") + F.when(F.col(truth).isNotNull(), 1).otherwise(0)
        top = F.greatest(F.col("_top_gt"), F.when(F.col(truth).isNotNull(), 1).otherwise(0))
        out.append(F.when(tv > 1, rnd(top / tv)).alias("sample_consistency_with_gt"))
    return s.select(*out)


def overall_consistency(per_sample: DataFrame, truth: str, by: list[str] | None = None,
                        exclude: str = str(UNKNOWN_CODE)) -> DataFrame:
    """Mean of A5/A6 over all samples and over samples whose truth ≠ 9."""
    by = by or []
    keep = F.col(truth).cast("string") != F.lit(exclude)
    aggs = [F.count(F.lit(1)).alias("n_samples"),
            _r6(F.avg("sample_consistency")).alias("overall_consistency"),
            _r6(F.avg(F.when(keep, F.col("sample_consistency")))).alias("overall_consistency_excl9")]
    if "sample_consistency_with_gt" in per_sample.columns:
        aggs += [_r6(F.avg("sample_consistency_with_gt")).alias("overall_consistency_with_gt"),
                 _r6(F.avg(F.when(keep, F.col("sample_consistency_with_gt"))))
                 .alias("overall_consistency_excl9_with_gt")]
    return per_sample.groupBy(*by).agg(*aggs)


def consistency_histogram(per_sample: DataFrame, cols: list[str], bins: int = 20) -> DataFrame:
    """Equal-width histogram over each column's own [min, max].

    Two passes, however many columns: one aggregate for all ranges (a scalar
    subquery of one row), one for all counts.  bin = floor((v-min)/(max-min)*bins),
    the maximum falls into the last bin.  Only non-empty bins are returned.
    """
    ends = per_sample.agg(*[f(c).alias(f"{m}{i}") for i, c in enumerate(cols) for m, f in (("lo", F.min), ("hi", F.max))])
    ends = ends.select(F.struct(*ends.columns)).scalar()
    cells = []
    for i, c in enumerate(cols):
        lo, width = ends[f"lo{i}"], ends[f"hi{i}"] - ends[f"lo{i}"]
        b = F.when(width == 0, F.lit(0)).otherwise(
            F.least(F.floor((F.col(c) - lo) / width * bins), F.lit(bins - 1))).cast("int")
        b = F.when(F.col(c).isNotNull(), b)
        cells.append(F.struct(F.lit(c).alias("metric"), b.alias("bin")))
    return (per_sample.select(F.explode(F.array(*cells)).alias("x")).where("x.bin is not null")
            .groupBy("x.metric", "x.bin").agg(F.count(F.lit(1)).alias("n")))


# -- A8 ---------------------------------------------------------------------------

def fleiss_kappa(long: DataFrame, sample: list[str], label: str, by: list[str] | None = None,
                 complete_only: bool = False) -> DataFrame:
    """Fleiss' kappa per ``by`` group (Fleiss 1971).

    Samples with at most one vote are skipped.  The statistic assumes every
    sample has the same number of votes: if they differ, kappa is null
    (``equal_votes`` false).  ``complete_only`` keeps only samples rated by
    the group's full rater count (max votes per sample).
    """
    given = by or []
    by = given or ["_g"]
    votes = long.where(F.col(label).isNotNull())
    if not given:
        votes = votes.withColumn("_g", F.lit(0))
    cnt = votes.groupBy(*by, *sample, label).agg(F.count(F.lit(1)).alias("c"))
    per = cnt.groupBy(*by, *sample).agg(
        F.sum("c").alias("n_i"), F.sum(F.col("c") * F.col("c")).alias("s2"),
        F.collect_list(F.struct(F.col(label).alias("l"), "c")).alias("_l")).where("n_i >= 2")
    # (group, votes per sample) and (group, votes per sample, label): a few rows
    # each, from which the full rater count is chosen without touching samples again.
    p_i = (F.col("s2") - F.col("n_i")) / (F.col("n_i") * (F.col("n_i") - 1))
    stats = per.groupBy(*by, "n_i").agg(F.count(F.lit(1)).alias("n"), F.sum(p_i).alias("p"))
    labels = (per.select(*by, "n_i", F.inline("_l")).groupBy(*by, "n_i", "l").agg(F.sum("c").alias("t")))
    return kappa_from_counts(stats, labels, by, complete_only).select(*given, "n_samples", "n_votes", "equal_votes", "kappa")


def kappa_from_counts(stats: DataFrame, labels: DataFrame, by: list[str], complete_only: bool) -> DataFrame:
    """Kappa from (by, n_i, n, p) — samples with n_i votes and the sum of their
    agreement — and (by, n_i, l, t) — votes per label.

    Squares are of label shares (double), so no count is large enough to
    overflow.
    """
    top = F.max("n_i").over(Window.partitionBy(*by))  # a row per distinct vote count
    if complete_only:
        stats = stats.withColumn("_k", top).where("n_i = _k")
        labels = labels.withColumn("_k", top).where("n_i = _k")
    g = stats.groupBy(*by).agg(
        F.sum("n").alias("n_samples"), (F.sum("p") / F.sum("n")).alias("p_bar"),
        F.min("n_i").alias("min_votes"), F.max("n_i").alias("max_votes"), F.sum(F.col("n") * F.col("n_i")).alias("n_votes"))
    per_label = labels.groupBy(*by, "l").agg(F.sum("t").alias("t"))
    share = F.col("t") / F.sum("t").over(Window.partitionBy(*by))
    e = per_label.withColumn("_s", share).groupBy(*by).agg(F.sum(F.col("_s") * F.col("_s")).alias("pe"))
    equal = F.col("min_votes") == F.col("max_votes")
    kappa = F.when(equal & (F.col("pe") < 1), _r6((F.col("p_bar") - F.col("pe")) / (1 - F.col("pe"))))
    return join_keys(g, e, by).select(*by, F.col("n_samples").cast("bigint").alias("n_samples"),
                                      F.col("n_votes").cast("bigint").alias("n_votes"),
                                      equal.alias("equal_votes"), kappa.alias("kappa"))


# -- A9/A10 -------------------------------------------------------------------------

def vote_rank(n: Column, first: Column) -> Column:
    """Orders vote groups by size, then by earliest ``first``: one DECIMAL with
    room for both whole ranges, so ``max_by`` stays a hash aggregate and neither
    can spill into the other."""
    wide = F.lit("18446744073709551616").cast("decimal(20,0)")
    return n.cast("decimal(17,0)") * wide - first.cast("decimal(20,0)")


def majority_vote(long: DataFrame, sample: list[str], label: str, order: str,
                  by: list[str] | None = None, keep: list[str] | None = None,
                  rounded: bool = True) -> DataFrame:
    """Winning label per sample and its share of the votes.

    Ties go to the label first seen in ``order`` (earliest run; an integer of
    any size).  One vote gives ratio 1.0; a sample with no
    non-null vote gets nulls.
    """
    by = by or []
    keep = keep or []
    rnd = _r6 if rounded else (lambda c: c)
    per = long.groupBy(*by, *sample, *keep, label).agg(
        F.count(label).alias("_n"), F.min(order).alias("_first"))
    v = per.groupBy(*by, *sample, *keep).agg(
        F.max_by(F.when(F.col("_n") > 0, F.col(label)), vote_rank(F.col("_n"), F.col("_first"))).alias("maj_pred"),
        F.sum("_n").alias("n_votes"), F.max("_n").alias("_top"))
    return v.select(*by, *sample, *keep, "maj_pred", F.col("n_votes").cast("bigint").alias("n_votes"),
                    F.when(F.col("n_votes") > 0, rnd(F.col("_top") / F.col("n_votes"))).alias("consistency"))


def self_consistency(long: DataFrame, sample: list[str], label: str, run: str, truth: str,
                     by: list[str], exclude=UNKNOWN_CODE) -> DataFrame:
    """A10: per model — runs, samples, mean vote share and majority accuracy,
    each over all samples and over samples whose truth is not ``exclude``.

    The run count is a separate distinct over (model, run): two columns,
    combined map-side, a handful of rows after the shuffle.
    """
    votes = majority_vote(long, sample, label, run, by, [truth], rounded=False)
    keep = F.col(truth) != F.lit(exclude)
    both = F.col(truth).isNotNull() & F.col("maj_pred").isNotNull()
    hit = F.when(both, (F.col(truth) == F.col("maj_pred")).cast("double"))
    summary = votes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_samples"),
        _r6(F.avg("consistency")).alias("self_consistency_incl9"),
        _r6(F.avg(F.when(keep, F.col("consistency")))).alias("self_consistency_excl9"),
        _r6(F.avg(hit)).alias("majority_acc_incl9"),
        _r6(F.avg(F.when(keep, hit))).alias("majority_acc_excl9"))
    runs = long.select(*by, run).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("num_runs"))
    return (join_keys(summary, runs, by)
            .select(*by, "num_runs", "n_samples", "self_consistency_incl9", "self_consistency_excl9",
                    "majority_acc_incl9", "majority_acc_excl9")
            .orderBy(F.col("self_consistency_incl9").desc(), *by))
