"""Language identification by families and pairwise linear SVMs (operator 6)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyspark.llm.common import table

#: Rows the models are fitted on at most, dealt evenly to the languages (of each
#: the smallest hashes of the id, and one row at least).
MAX_LABELLED = 4_000
#: Hashed character n-grams (of bytes, 1 to ORDERS) of lower-cased text.
BITS, ORDERS = 13, 4
UNKNOWN = "und"
#: Relative error of a language's estimated size when rows are drawn.
ERROR = 0.02
#: Language families (fixed values); a language not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "ur", "mr", "pa", "gu"),
    "uralic": ("fi", "et", "hu"),
}


def family(lang: str) -> str:
    return next((f for f, ls in FAMILIES.items() if lang in ls), lang)


def _grams(data: np.ndarray) -> np.ndarray:
    """Hashed n-grams of a byte array, (len, ORDERS); those that would run over
    the end are slot 0 of their order."""
    n = len(data)
    out = np.zeros((ORDERS, n), np.uint32)
    h = np.zeros(n, np.uint32)
    for k in range(ORDERS):
        h[: n - k] = h[: n - k] * np.uint32(0x01000193) + data[k:] + np.uint32(1)
        x = (h[: n - k] * np.uint32(0x9E3779B1) + np.uint32(k * 0x7FEB352D & 0xFFFFFFFF)) >> np.uint32(32 - BITS)
        out[k, : n - k] = x
    return out


def _lettered(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


#: Bytes hashed at once; longer texts are added up in slices.
SLICE = 1 << 18


def _slices(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of many texts, the start of each text's part, and its number."""
    held: list[bytes] = []
    who: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        data = (" " + t.lower() + " ").encode("utf-8", "replace") if t else b" "
        for a in range(0, len(data), SLICE):
            held.append(data[a:a + SLICE])
            who.append(i)
            size += len(held[-1])
            if size >= SLICE:
                yield np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)])[:-1], np.array(who)
                held, who, size = [], [], 0
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)])[:-1], np.array(who)


def project(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    """(len(texts), models): mean weight of each text's n-grams, those of
    ``histograms`` whatever texts stand beside it.  ``weights``: (2^BITS, models)."""
    out = np.zeros((len(texts), weights.shape[1]))
    size = np.zeros(len(texts))
    for data, at, who in _slices(texts):
        grams, ends = _grams(data), np.r_[at[1:], len(data)]
        for back in range(1, ORDERS):  # nor does a gram run over into the next text
            last = ends - back
            grams[back:, last[last >= at]] = 0
        total = weights[grams].sum(0) if weights.shape[1] > 1 else weights[:, 0][grams].sum(0)[:, None]
        np.add.at(out, who, np.add.reduceat(total, at, axis=0))
        np.add.at(size, who, ORDERS * (ends - at))
    return out / np.maximum(size, 1)[:, None]


def histograms(texts: list[str | None]) -> np.ndarray:
    """(len(texts), 2^BITS) shares of n-grams."""
    out = np.zeros((len(texts), 1 << BITS), np.float32)
    for data, at, who in _slices(texts):
        for a, b, i in zip(at, np.r_[at[1:], len(data)], who, strict=True):
            g = _grams(data[a:b])
            out[i] += np.bincount(g.ravel(), minlength=1 << BITS)
    return out / np.maximum(out.sum(1, keepdims=True), 1)


@dataclass
class Hierarchy:
    """Families told apart first, then the languages within one.

    Each decision is one against one: a linear support vector machine per pair,
    the votes (then the margins) decide.
    """

    families: list[str]
    languages: dict[str, list[str]]
    pairs: list[tuple[str, str, str]] = field(default_factory=list)  # level, first, second
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.families:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        margin = project(texts, self.weights) + self.bias if self.pairs else np.zeros((len(texts), 0))
        at = {p: j for j, p in enumerate(self.pairs)}

        def choose(level: str, names: list[str], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Index of the winner, and its share of sure votes, for each row."""
            vote, sure = np.zeros((len(rows), len(names))), np.zeros((len(rows), len(names)))
            for (i, a), (j, b) in combinations(enumerate(names), 2):
                p = 1 / (1 + np.exp(-np.clip(4 * margin[rows, at[level, a, b]], -40, 40)))
                vote[:, i] += p >= 0.5
                vote[:, j] += p < 0.5
                sure[:, i] += p
                sure[:, j] += 1 - p
            n = max(1, len(names) - 1)
            best = (vote + sure / (n + 1) / 2).argmax(1) if len(names) > 1 else np.zeros(len(rows), int)
            return best, (sure[np.arange(len(rows)), best] / n if len(names) > 1 else np.ones(len(rows)))

        all_rows = np.arange(len(texts))
        fam, score = choose("", self.families, all_rows)
        lang = np.full(len(texts), UNKNOWN, object)
        for f, name in enumerate(self.families):
            rows = all_rows[fam == f]
            if len(rows):
                own = self.languages[name]
                best, s = choose(name, own, rows)
                lang[rows] = np.array(own, object)[best]
                score[rows] *= s
        none = np.array([not _lettered(t) for t in texts], bool)
        lang[none], score[none] = UNKNOWN, 0.0
        return lang.tolist(), np.clip(score, 0, 1)


#: A machine is fitted until its gradient is that small against the first one.
TOLERANCE = 1e-3


def linear_svm(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, tolerance: float = TOLERANCE) -> tuple[np.ndarray, float]:
    """Weights and bias of a squared-hinge linear SVM by accelerated full
    gradients, restarted where they overshoot, until the gradient's norm is
    ``tolerance`` of the first; both classes weigh alike.  ``y`` is -1 or 1."""
    c = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    vw, vb = w.copy(), b
    step = 1 / (2 * float((c * ((x * x).sum(1) + 1)).sum()) + ridge)
    first, t = None, 0
    while True:
        g = -2 * c * y * np.maximum(0, 1 - y * (x @ vw + vb))
        gw, gb = x.T @ g + ridge * vw, float(g.sum())
        norm = float(np.sqrt((gw * gw).sum(dtype=float) + gb * gb))
        first = norm if first is None else first
        if norm <= tolerance * first:
            return vw, vb
        nw, nb = vw - step * gw, vb - step * gb
        if t and nb == b and (nw == w).all():  # no step is left in these numbers
            return w, b
        if float(gw @ (nw - w)) + gb * (nb - b) > 0:  # uphill: the momentum goes
            t = 0
        k = t / (t + 3)
        vw, vb, w, b, t = nw + k * (nw - w), nb + k * (nb - b), nw, nb, t + 1


def draw(labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """lang, doc_id, text of at most ``max_labelled`` rows, as many of each
    language as of any other that has them (one at least): the smallest hashes of
    the id, then the smallest ids.  Rows that repeat an id within a language count once,
    with the greatest text.

    An estimate of each language's ids (a mergeable sketch, so no id is shuffled
    for it) gives a bound for the hash that a few more rows than needed pass, six
    standard errors of the estimate and of the hash allowed; only those rows are
    kept, and their ids ranked.
    """
    rows = labelled.filter("lang is not null and text is not null and doc_id is not null").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(
        F.approx_count_distinct("doc_id", ERROR).alias("n")).collect()}
    each = max(1, max_labelled // max(1, len(counts)))
    enough = (1 + 6 * ERROR) * each + 6 * each ** 0.5 + 50
    spark = labelled.sparkSession
    cuts = spark.createDataFrame([(x, min(2 ** 63 - 1, int(2 ** 63 * min(1.0, enough / n)))) for x, n in counts.items()],
                                 "lang string, cut long")
    place = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string")), 1)
    passed = table(rows.join(F.broadcast(cuts), "lang").filter(place <= F.col("cut"))
                   .groupBy("lang", "doc_id").agg(F.max("text").alias("text")), "language_candidates")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(place, "doc_id"))
    chosen = passed.select("lang", "doc_id", rank.alias("rank")).filter(F.col("rank") <= each).select("lang", "doc_id")
    return passed.join(chosen, ["lang", "doc_id"])


def _grams_of(sample: DataFrame) -> DataFrame:
    """lang, doc_id and the shares of the text's n-grams: places and values of
    those above zero, so a row is small however long its text is."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.iloc[i:i + 256]
                x = histograms(part["text"].tolist())
                at = [np.flatnonzero(r) for r in x]
                yield pd.DataFrame({"lang": part["lang"], "doc_id": part["doc_id"],
                                    "places": [p.astype(np.uint16).tobytes() for p in at],
                                    "shares": [r[p].tobytes() for r, p in zip(x, at, strict=True)]})
    return sample.select("lang", "doc_id", "text").mapInPandas(run, "lang string, doc_id long, places binary, shares binary")


def fit(labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> Hierarchy:
    """The models from rows (doc_id, text, lang), of which at most
    ``max_labelled`` count (see ``draw``).  Each pair's machine is fitted by a task
    of its own on the sample's n-gram shares.  Without rows nothing is learned and
    all is ``und``."""
    sample = table(_grams_of(draw(labelled, max_labelled)), "language_sample")
    langs = sorted(r[0] for r in sample.select("lang").distinct().collect())
    by_family = defaultdict(list)
    for x in langs:
        by_family[family(x)].append(x)
    model = Hierarchy(sorted(by_family), dict(by_family))
    jobs = [("", a, b) for a, b in combinations(model.families, 2)]
    jobs += [(f, a, b) for f in model.families for a, b in combinations(by_family[f], 2)]
    if not jobs:
        return model
    plan = []
    for j, (level, a, b) in enumerate(jobs):
        for x in langs:
            s = family(x) if level == "" else x
            if s in (a, b):
                plan.append((j, x, 1.0 if s == a else -1.0))
    spark = sample.sparkSession
    plan = spark.createDataFrame(plan, "job int, lang string, side double")

    def train(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["lang", "doc_id"])
        x = np.zeros((len(part), 1 << BITS), np.float32)
        for r, p, v in zip(x, part["places"], part["shares"], strict=True):
            r[np.frombuffer(p, np.uint16)] = np.frombuffer(v, np.float32)
        mean = x.mean(0)
        scale = 1 / np.sqrt(mean + 1e-6)  # frequent and rare n-grams count alike
        w, b = linear_svm((x - mean) * scale, part["side"].to_numpy(np.float32))
        w = (w * scale).astype(np.float32)
        return pd.DataFrame({"job": [int(part["job"].iloc[0])], "weights": [w.tobytes()], "bias": [float(b - mean @ w)]})

    fitted = sample.join(plan, "lang").groupBy("job").applyInPandas(train, "job int, weights binary, bias double").collect()
    fitted.sort(key=lambda r: r["job"])
    model.pairs = [jobs[r["job"]] for r in fitted]
    model.weights = np.stack([np.frombuffer(r["weights"], np.float32) for r in fitted], 1)
    model.bias = np.array([r["bias"] for r in fitted], np.float32)
    return model


def identify(docs: DataFrame, model: Hierarchy) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) of every whole text.

    Null text, and text without a letter, is ``und`` with score 0; so is all if
    nothing was learned.  One row per row of ``docs``, null ids included.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lang, score = model.predict(b["text"].tolist())
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "lang_pred": lang, "score": score})
    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, lang_pred string, score double")
