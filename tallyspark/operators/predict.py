"""Pluggable batch prediction (T5).

A predictor is built once per task on the executor (model weights are loaded
there, not shipped per row) and applied to Arrow batches of its input columns;
all other columns stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class BatchPredictor(Protocol):
    def predict(self, batch: pd.DataFrame) -> pd.Series: ...


def predict_table(df: DataFrame, make_predictor: Callable[[], BatchPredictor], out: str,
                  out_type: T.DataType, input_cols: list[str] | None = None) -> DataFrame:
    """T5: add column ``out`` = predictor(batch of ``input_cols``) for every row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        model = make_predictor()
        for batch in batches:
            yield model.predict(batch) if len(batch) else pd.Series([], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.DataFrame], "return": Iterator[pd.Series]}
    predict = F.pandas_udf(run, out_type)
    return df.withColumn(out, predict(F.struct(*(input_cols or df.columns))))


def class_centroids(df: DataFrame, vec: str, label: str) -> DataFrame:
    """(label, centroid): the mean vector of each class, one row per class; sums
    are combined map-side per (class, position)."""
    cells = (df.select(label, F.posexplode(vec).alias("pos", "x"))
             .groupBy(label, "pos").agg(F.avg("x").alias("mean")))
    return cells.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("pos", "mean"))).alias("_c")).select(
        label, F.col("_c.mean").alias("centroid"))


def centroid_predictor(train: DataFrame, vec: str, label: str) -> Callable[[], BatchPredictor]:
    """Fit centroids on Spark, return a factory for executors: the label of the
    nearest centroid (squared Euclidean distance; ties: smaller label).  The model
    — one vector per class, whatever the number of rows — travels in its closure."""
    model = sorted((r[label], list(r["centroid"])) for r in class_centroids(train, vec, label).collect())

    def make():
        # Defined here so the factory ships by value: executors need numpy
        # and pandas, not this package on their path.
        import numpy as np
        import pandas as pd

        class Nearest:
            labels = np.asarray([m[0] for m in model])
            centres = np.asarray([m[1] for m in model], dtype=np.float64)

            def predict(self, batch):
                x = np.stack([np.asarray(v, dtype=np.float64) for v in batch[vec]])
                d = ((x[:, None, :] - self.centres[None, :, :]) ** 2).sum(2)
                return pd.Series(self.labels[np.argmin(d, axis=1)])

        return Nearest()
    return make
