"""Operator 6: the labelled rows drawn, the machines, and held-out accuracy of the query."""

import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm import langid, queries

SF = "/root/testdata/sf0.01"


def test_every_language_is_drawn_alike(spark):
    rows = [(i, f"text {i}", "en") for i in range(3_000)] + [(i, f"texte {i}", "fr") for i in range(3_000, 3_400)]
    rows += [(i, f"tekst {i}", "nl") for i in range(3_400, 3_405)] + [(7, "again", "en"), (7, "zebra", "en"), (1, None, "fr"),
                                                                    (None, "x", "fr"), (9, "x", None)] + [(8, "same", "de")] * 2_000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.draw(docs, 400).collect()
    by = {x: {r["doc_id"]: r["text"] for r in got if r["lang"] == x} for x in ("en", "fr", "nl", "de")}
    assert len(got) == sum(map(len, by.values())) and {x: len(v) for x, v in by.items()} == {"en": 100, "fr": 100, "nl": 5, "de": 1}
    place = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string")), 1)
    for x, low, high in (("en", 0, 3_000), ("fr", 3_000, 3_400)):
        least = spark.range(low, high).withColumnRenamed("id", "doc_id").orderBy(place, "doc_id").limit(100).collect()
        assert set(by[x]) == {r[0] for r in least}
    whole = {r["doc_id"]: r["text"] for r in langid.draw(docs, 100_000).collect() if r["lang"] == "en"}
    assert whole[7] == "zebra" and len(whole) == 3_000
    assert len(langid.draw(docs, 2).collect()) == 4  # one of each language at least


def test_machines_are_fitted_to_the_optimum():
    r = np.random.default_rng(3)
    x = r.normal(size=(60, 5)).astype(np.float32)
    y = np.where(x @ np.array([1, -2, 0.5, 0, 1]) + 0.7 * r.normal(size=60) > 0.3, 1, -1).astype(np.float32)

    def loss(w, b):
        c = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
        return float((c * np.maximum(0, 1 - y * (x @ w + b)) ** 2).sum() + 0.5e-4 * (w * w).sum())
    w, b = langid.linear_svm(x, y, tolerance=1e-5)
    best = loss(w, b)
    c = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    slope = np.linalg.norm([*(-2 * (c * y) @ x), -2 * (c * y).sum()]) * 1e-5
    for _ in range(300):  # convex: no point is better by more than the slope left times its distance
        d = r.normal(size=6) * r.choice([0.01, 0.1, 1])
        assert loss(w + d[:5], b + d[5]) >= best - slope * np.linalg.norm(d) - 1e-6
    same = np.ones((4, 3), np.float32)
    assert np.isfinite(langid.linear_svm(same, np.array([1, -1, 1, -1], np.float32))[0]).all()


def test_held_out_accuracy_of_every_language(spark):
    got = queries.QUERIES["op6_language_id"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got.count() == docs.count()
    said = got.filter("held_out").join(docs.filter("lang is not null and text is not null"), "doc_id")
    rates = {r["lang"]: r["rate"] for r in said.groupBy("lang").agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("rate")).collect()}
    assert len(rates) > 1 and min(rates.values()) >= 0.95, rates
