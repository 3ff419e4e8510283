"""Toxicity severity by cumulative-link ordinal regression (operator 3)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import one_per_id, table, whole_text

#: Labelled rows that the model is fitted on at most (drawn by a hash of the id,
#: each grade by its share), and sparse text features it keeps.
MAX_LABELLED = 12_000
FEATURES = 600
#: A feature stands in that many labelled texts at least.
MIN_TEXTS = 3
STEMS = (4, 5)
THRESHOLD = 0.5
#: Texts scored, or taken apart into features, at once.
SLICE = 256
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> Counter:
    """Counts of the text's words and of their stems (first characters, marked
    with *), case folded."""
    words = Counter(_WORD.findall(text.lower())) if text else Counter()
    out = Counter(words)
    for w, n in words.items():
        for k in STEMS:
            if len(w) > k:
                out[w[:k] + "*"] += n
    return out


@dataclass
class OrdinalModel:
    """P(grade > k) = sigmoid(w·x - theta_k): one weight per feature, shared by
    all thresholds, which ascend.  x is log(1 + count)."""

    vocabulary: list[str]
    weights: np.ndarray
    theta: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        weight = dict(zip(self.vocabulary, self.weights.tolist(), strict=True))
        out = np.zeros(len(texts))
        for i, t in enumerate(texts):
            if not t:
                continue
            stem = Counter()
            s = 0.0
            for w, n in Counter(_WORD.findall(t.lower())).items():
                if w in weight:
                    s += weight[w] * np.log1p(n)
                for k in STEMS:
                    if len(w) > k and (f := w[:k] + "*") in weight:
                        stem[f] += n
            out[i] = s + sum(weight[f] * np.log1p(n) for f, n in stem.items())
        return out

    def above(self, scores: np.ndarray) -> np.ndarray:
        """(n, thresholds) probabilities of a grade above each threshold."""
        z = np.clip(scores[:, None] - self.theta[None, :], -40, 40)
        return 1 / (1 + np.exp(-z))


def fit_ordinal(rows: list[np.ndarray], counts: list[np.ndarray], grades: np.ndarray, n_features: int,
                steps: int = 400, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds by Adam on the mean log-likelihood.

    Thresholds are the first plus exponentials, so their order holds at every
    step.  Grades must be 0, 1, ... without gaps.
    """
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
    x = np.log1p(np.concatenate(counts).astype(float)) if rows else np.zeros(0)
    k = int(grades.max())
    share = np.array([np.mean(grades > j) for j in range(k)]).clip(1e-3, 1 - 1e-3)
    first = np.log((1 - share) / share)
    par = np.zeros(n_features + k)
    par[n_features] = first[0]
    par[n_features + 1:] = np.log(np.maximum(np.diff(first), 0.05))
    m, v = np.zeros_like(par), np.zeros_like(par)
    n = max(1, len(rows))
    for t in range(1, steps + 1):
        w, gap = par[:n_features], np.exp(np.clip(par[n_features + 1:], -20, 20))
        theta = par[n_features] + np.concatenate([[0.0], np.cumsum(gap)])
        eta = np.bincount(at, x * w[col], minlength=len(rows))
        up = np.ones((len(rows), k + 2))  # P(grade >= j), j = 0 .. k + 1
        up[:, k + 1] = 0
        up[:, 1:k + 1] = 1 / (1 + np.exp(-np.clip(eta[:, None] - theta[None, :], -40, 40)))
        i = np.arange(len(rows))
        p = np.maximum(up[i, grades] - up[i, grades + 1], 1e-12)
        slope = up * (1 - up)
        # derivative of log p by eta, and by each theta
        d_eta = (slope[i, grades] - slope[i, grades + 1]) / p
        d_theta = np.zeros(k)
        for j in range(1, k + 1):
            d_theta[j - 1] = (-(slope[grades == j, j] / p[grades == j]).sum()
                              + (slope[grades == j - 1, j] / p[grades == j - 1]).sum())
        g = np.zeros_like(par)
        g[:n_features] = np.bincount(col, x * d_eta[at], minlength=n_features) / n - ridge * w
        g[n_features] = d_theta.sum() / n
        g[n_features + 1:] = np.cumsum(d_theta[::-1])[::-1][1:] * gap / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        par += 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
    gap = np.exp(np.clip(par[n_features + 1:], -20, 20))
    return par[:n_features], par[n_features] + np.concatenate([[0.0], np.cumsum(gap)])


def _counted(rows: DataFrame, vocabulary: list[str] | None, carry: str) -> DataFrame:
    """carry columns and features (array<string>), counts (array<int>)."""
    keep = set(vocabulary) if vocabulary is not None else None
    names = [c.split()[0] for c in carry.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, max(1, len(batch)), SLICE):  # the features of few texts at a time
                b = batch.iloc[i:i + SLICE]
                found = [{f: n for f, n in features(t).items() if keep is None or f in keep} for t in b["text"]]
                out = b[names].copy()
                out["features"] = [list(f) for f in found]
                out["counts"] = [list(f.values()) for f in found]
                yield out

    return rows.select(*names, "text").mapInPandas(run, f"{carry}, features array<string>, counts array<int>")


def fit(labelled: DataFrame, max_labelled: int = MAX_LABELLED, n_features: int = FEATURES) -> OrdinalModel | None:
    """The model from labelled rows (doc_id, text, grade 0, 1, ...).

    At most ``max_labelled`` rows are used: the smallest hashes of the id.  The
    features kept are those whose presence tells most about grade > 0 (chi
    square).  None if there is no row, or only one grade.
    """
    rows = labelled.filter(F.col("grade").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "grade")
    sample = table(rows.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(max_labelled), "labelled")
    total = sample.agg(F.count("*").alias("n"), F.sum(F.expr("int(grade > 0)")).alias("pos")).first()
    if not total["n"] or not total["pos"] or total["pos"] == total["n"]:
        return None
    found = table(_counted(sample.repartition(sample.sparkSession.sparkContext.defaultParallelism), None,
                           "doc_id long, grade int"), "features")
    per = found.select(F.explode("features").alias("f"), (F.col("grade") > 0).cast("int").alias("y")).groupBy("f").agg(
        F.count("*").alias("n"), F.sum("y").alias("pos")).filter(F.col("n") >= MIN_TEXTS)
    n, pos = F.lit(float(total["n"])), F.lit(float(total["pos"]))
    gap = F.col("pos") * n - F.col("n") * pos
    chi = gap * gap / (F.col("n") * (n - F.col("n")) + 1)
    vocabulary = [r["f"] for r in per.withColumn("chi", chi).orderBy(F.col("chi").desc(), "f").limit(n_features).collect()]
    place = {f: i for i, f in enumerate(vocabulary)}
    data = _counted(sample, vocabulary, "doc_id long, grade int").orderBy("doc_id").collect()
    grades = np.array([r["grade"] for r in data])
    levels = np.unique(grades)
    grades = np.searchsorted(levels, grades)
    w, theta = fit_ordinal([np.array([place[f] for f in r["features"]], np.int64) for r in data],
                           [np.array(r["counts"], float) for r in data], grades, len(vocabulary))
    return OrdinalModel(vocabulary, w, theta)


def binary_grades(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, text, grade of at most ``max_labelled`` documents with binary
    toxic labels (smallest hashes of the id): 0 for a clean text; toxic ones are
    grade 1 or 2 as the number of their words that mark toxic texts is below the
    median of the toxic ones or not.  Marking words stand in at least
    ``MIN_TEXTS`` toxic texts and in no clean one.  It is their number, not their
    share, as the model sees counts too: by share a long text with many of them
    is graded below a short one with few, which no weight can follow.  A document labelled more than
    once counts by its highest label; null labels do not count."""
    label = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    label = label.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    label = table(label.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(max_labelled), "labels")
    rows = table(one_per_id(docs, "doc_id", ["text"]).join(F.broadcast(label), "doc_id"), "labelled_texts")
    words = rows.select("doc_id", "toxic", F.explode(F.regexp_extract_all(F.lower(whole_text()), F.lit(r"\p{L}++"), F.lit(0))).alias("w"))
    marking = (words.groupBy("w").agg(F.countDistinct(F.when(F.col("toxic") > 0, F.col("doc_id"))).alias("bad"),
                                      F.max(F.expr("int(toxic = 0)")).alias("good"))
               .filter(F.col("bad") >= MIN_TEXTS).filter("good = 0").select("w"))
    marks = (words.filter("toxic > 0").join(marking.withColumn("mark", F.lit(1)), "w", "left").groupBy("doc_id")
             .agg(F.count("mark").alias("marks")))
    middle = marks.agg(F.percentile_approx("marks", 0.5, 10_000)).first()[0]
    return rows.join(marks, "doc_id", "left").select(
        "doc_id", "text", F.when(F.col("toxic") <= 0, 0).when(F.coalesce("marks", F.lit(0)) < F.lit(middle or 0), 1)
        .otherwise(2).alias("grade"))


def severity_column(model: OrdinalModel | None, threshold: float = THRESHOLD):
    """A function of a text column: struct of severity, p_toxic, grade, toxic
    (see ``severity``)."""
    @F.pandas_udf("severity double, p_toxic double, grade int, toxic boolean")
    def judge(text: pd.Series) -> pd.DataFrame:
        parts = []
        for i in range(0, max(1, len(text)), SLICE):  # few texts at a time as Python strings
            texts = text.iloc[i:i + SLICE].tolist()
            up = model.above(model.scores(texts)) if model else np.zeros((len(texts), 1))
            up[[not t for t in texts]] = 0
            parts.append(up)
        up = np.concatenate(parts)
        return pd.DataFrame({"severity": up.sum(1), "p_toxic": up[:, 0], "grade": (up >= 0.5).sum(1).astype("int32"),
                             "toxic": up[:, 0] >= threshold})
    return judge


def severity(docs: DataFrame, model: OrdinalModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """Expected severity of every text.

    Returns doc_id, severity (sum over thresholds of P(grade above it)),
    p_toxic (P(grade > 0)), grade (the number of thresholds that are more
    likely passed than not), toxic (p_toxic at least ``threshold``).  Null or
    empty text, and every text without a model, has severity 0 and is
    not toxic.  One row per row of ``docs``, null ids included.
    """
    judged = docs.select("doc_id", severity_column(model, threshold)(F.col("text")).alias("j"))
    return judged.select("doc_id", "j.severity", "j.p_toxic", "j.grade", "j.toxic")
