"""Joint softmax training (B3) against Spark ML's fit of each label set alone."""

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from tallyspark.operators import baseline as B
from tallyspark.operators import softmax as S

CLASSES = 3


def rows(spark):
    docs = spark.createDataFrame([(i, f"w{i % CLASSES} v{i % 5} u{i * i % 7} common" if i % 31 else "", i % CLASSES)
                                  for i in range(120)], "doc_id long, text string, y int").repartition(4)
    feats = B.bow_features("text", 50).fit(docs).transform(docs)
    def flipped(k):
        return F.when(F.col("doc_id") % k == 0, (F.col("y") + 1) % CLASSES).otherwise(F.col("y"))
    third = F.when(F.col("doc_id") < 60, F.col("y")).otherwise(-1)  # a model with fewer rows
    return feats.select("doc_id", "features", "y", F.array(flipped(4), flipped(2), third).alias("ys")).persist()


def test_each_model_equals_its_own_fit(spark):
    data = rows(spark)
    weights = S.fit_together(data.select("features", F.slice("ys", 1, 2).alias("ys")), 2, CLASSES, 0.01, 1e-9)
    for m in range(2):
        lr = LogisticRegression(featuresCol="features", labelCol="_y", maxIter=2000, tol=1e-12, regParam=0.01, family="multinomial")
        model = lr.fit(data.withColumn("_y", F.col("ys")[m].cast("double")))
        coef = model.coefficientMatrix.toArray().T
        assert np.abs(weights[m][:-1] - coef).max() < 1e-2 * np.abs(coef).max()
        own, ref = weights[m][-1], model.interceptVector.toArray()
        assert np.abs((own - own.mean()) - (ref - ref.mean())).max() < 2e-2
    said = {r["doc_id"]: r["pred"] for r in S.predict_together(data, weights, ["doc_id"]).collect()}
    assert len(said) == 120 and all(len(p) == 2 for p in said.values())
    ref = {r["doc_id"]: int(r["prediction"]) for r in model.transform(data).collect()}
    assert sum(said[i][1] == ref[i] for i in ref) >= 118


def test_jobs_do_not_grow_with_models(spark, monkeypatch):
    data = rows(spark)
    passes, whole = [], S.gradient_pass

    def counted(*args):
        passes.append(len(args[2]))
        return whole(*args)
    monkeypatch.setattr(S, "gradient_pass", counted)
    alone = []
    for m in range(3):
        passes.clear()
        S.fit_together(data.select("features", F.slice("ys", m + 1, 1).alias("ys")), 1, CLASSES, 0.01)
        alone.append(len(passes))
    passes.clear()
    S.fit_together(data, 3, CLASSES, 0.01)
    assert passes[0] == 3 and abs(len(passes) - max(alone)) <= 2 and len(passes) < sum(alone)


def test_rows_without_a_model_and_empty_texts(spark):
    data = rows(spark)
    none = data.select("features", F.array(F.lit(-1), F.col("y")).alias("ys"))
    weights = S.fit_together(none, 2, CLASSES, 0.01)
    assert not weights[0].any() and weights[1].any()
    assert S.predict_together(data.where("false"), weights, ["doc_id"]).count() == 0


def test_descent_finds_the_minimum_of_a_quadratic():
    a = np.diag([1.0, 10.0, 100.0])
    b = np.array([1.0, -2.0, 3.0])

    def evaluate(points):
        return {i: (0.5 * w @ a @ w - b @ w, a @ w - b) for i, w in points.items()}
    for w in S.descend_together(evaluate, np.zeros(3), 2, 1e-10, 200):
        assert np.allclose(w, np.linalg.solve(a, b), atol=1e-6)
