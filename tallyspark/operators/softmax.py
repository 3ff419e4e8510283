"""Softmax regression for many label sets of the same rows, all in one pass a step.

The rows' features are shared; only labels differ (noise levels, say).  Each
step is one Spark job that computes the losses and gradients of all models still
in training: a partition adds up its rows' share of every gradient, and the
shares are added per feature by an aggregate.  The number of jobs is that of the
slowest model and does not grow with the number of models.

What comes to the driver is (features + 2) × classes × models numbers a step,
bounded by the vocabulary; rows never do.
"""

from __future__ import annotations

from collections.abc import Callable, Generator

import numpy as np
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pairs of steps that the curvature is estimated from.
MEMORY = 10
#: Entries of sparse rows worked on at a time by a task.
ENTRIES = 1 << 16


def sparse_columns(features: str = "features") -> list[Column]:
    """``_i`` and ``_v``: places and values of a sparse vector column."""
    raw = F.unwrap_udt(F.col(features))
    return [raw["indices"].alias("_i"), raw["values"].alias("_v")]


def _sliced(batch, entries: int):
    """(first row, last row, places, values, row of each entry, starts, rows that
    have entries) of an Arrow batch, some ``entries`` at a time."""
    import numpy as np
    import pyarrow.compute as pc

    lists = batch.column("_i")
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    places = lists.flatten().to_numpy(zero_copy_only=False)
    values = batch.column("_v").flatten().to_numpy(zero_copy_only=False)
    a = 0
    while a < len(sizes):
        b = max(a + 1, min(a + 4096, int(np.searchsorted(ends, ends[a] + entries, "right")) - 1))
        s, e = ends[a], ends[b]
        some = np.flatnonzero(sizes[a:b])
        yield a, b, places[s:e], values[s:e], np.repeat(np.arange(b - a), sizes[a:b]), ends[a:b][some] - s, some
        a = b


def _scores(w, m, places, values, starts, some):
    """Scores of ``m`` rows under the weights ``w`` (last line: intercepts)."""
    import numpy as np

    z = np.tile(w[-1], (m, 1))
    if len(some):
        z[some] += np.add.reduceat(w[places] * values[:, None], starts)
    return z


def gradient_pass(rows: DataFrame, weights: np.ndarray, models: list[int], classes: int,
                  n_models: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over all rows (_i, _v, ys: a class per model, -1 for none): losses and
    numbers of rows per model of ``models``, and the gradient by ``weights``
    (features + 1 lines, classes × models columns)."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(weights)  # vocabulary × classes × models, as in the module's text
    k = len(models)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        w = sent.value
        grad, touched = np.zeros_like(w), np.zeros(len(w), bool)
        loss, known = np.zeros(k), np.zeros(k)
        for batch in batches:
            labels = batch.column("ys").flatten().to_numpy(zero_copy_only=False).reshape(-1, n_models)[:, models]
            for a, b, places, values, at, starts, some in _sliced(batch, ENTRIES):
                z = _scores(w, b - a, places, values, starts, some).reshape(b - a, k, classes)
                z -= z.max(2, keepdims=True)
                p = np.exp(z)
                total = p.sum(2)
                p /= total[:, :, None]
                y = labels[a:b]
                row, model = np.nonzero(y >= 0)
                cls = y[row, model]
                np.add.at(loss, model, np.log(total[row, model]) - z[row, model, cls])
                known += (y >= 0).sum(0)
                p[row, model, cls] -= 1
                p[y < 0] = 0
                r = p.reshape(b - a, k * classes)
                grad[-1] += r.sum(0)
                if len(places):
                    order = np.argsort(places, kind="stable")
                    first = np.flatnonzero(np.diff(places[order], prepend=-1))
                    grad[places[order][first]] += np.add.reduceat((r[at] * values[:, None])[order], first)
                    touched[places] = True
        touched[-1] = True
        lines = np.flatnonzero(touched)
        tail = np.zeros((1, k * classes))
        tail[0, :k], tail[0, k:2 * k] = loss, known
        out = np.concatenate([grad[lines], tail])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(lines, len(w)), pa.int32()),
                                          *(pa.array(c) for c in out.T)], ["j", *(f"g{c}" for c in range(out.shape[1]))])

    names = [f"g{c}" for c in range(k * classes)]
    summed = (rows.select("_i", "_v", "ys").mapInArrow(run, ", ".join(["j int", *(f"{c} double" for c in names)]))
              .groupBy("j").agg(*(F.sum(c).alias(c) for c in names)).toArrow())
    sent.unpersist()
    out = np.zeros((len(weights) + 1, len(names)))
    out[summed.column("j").to_numpy()] = np.stack([summed.column(c).to_numpy() for c in names], 1)
    return out[-1, :k], out[-1, k:2 * k], out[:-1]


def descend(w: np.ndarray, tolerance: float, max_steps: int) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Limited-memory quasi-Newton steps from ``w`` (Nocedal 1980), as a generator:
    yields points, is sent (value, gradient) there, returns the last point.  Ends
    when the gradient is ``tolerance`` of the first, or when the last ``MEMORY``
    steps lowered the value by less than ``tolerance`` of it."""
    value, grad = yield w
    goal = tolerance * np.linalg.norm(grad)
    values = [value]
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_steps):
        if np.linalg.norm(grad) <= goal or (len(values) > MEMORY and values[-1 - MEMORY] - value <= tolerance * abs(value)):
            break
        d, factors = -grad, []
        for s, y in reversed(steps):
            factors.append((s @ d) / (s @ y))
            d = d - factors[-1] * y
        if steps:
            s, y = steps[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), f in zip(steps, reversed(factors)):
            d = d + (f - (y @ d) / (s @ y)) * s
        length = 1.0 if steps else 1 / max(1.0, np.linalg.norm(grad))
        while True:
            new_value, new_grad = yield w + length * d
            if new_value <= value + 1e-4 * length * (grad @ d):
                break
            length /= 2
            if length < 1e-12:
                return w
        s, y = length * d, new_grad - grad
        if s @ y > 1e-14:
            steps = [*steps, (s, y)][-MEMORY:]
        w, value, grad = w + s, new_value, new_grad
        values.append(value)
    return w


def descend_together(evaluate: Callable[[dict], dict], start: np.ndarray, n: int, tolerance: float,
                     max_steps: int) -> list[np.ndarray]:
    """``n`` descents in step: ``evaluate`` is asked once a step for all that still run."""
    runs = [descend(start, tolerance, max_steps) for _ in range(n)]
    points, ends = {i: next(r) for i, r in enumerate(runs)}, {}
    while points:
        for i, found in evaluate(points).items():
            try:
                points[i] = runs[i].send(found)
            except StopIteration as end:
                ends[i] = end.value
                del points[i]
    return [ends[i] for i in range(n)]


def fit_together(rows: DataFrame, n_models: int, classes: int, ridge: float, tolerance: float = 1e-3,
                 max_steps: int = 2000) -> np.ndarray:
    """models × (features + 1) × classes weights, the last line the intercepts.

    ``rows``: ``features`` (sparse vector) and ``ys`` (array<int>: the class under
    each model, -1 if the row is not the model's).  Keep the rows stored; they
    are read once a step.  Minimised is the mean log loss plus half ``ridge``
    times the squared weights of features scaled to unit deviation; constant
    features weigh nothing.  A model without rows has weights of 0.
    """
    spread = rows.select(Summarizer.std(F.col("features")).alias("s")).first()["s"]
    deviation = spread.toArray() if spread is not None else np.zeros(0)
    scale = np.append(np.divide(1.0, deviation, out=np.zeros_like(deviation), where=deviation > 0), 1.0)[:, None]
    penalty = np.append(np.full(len(deviation), ridge), 0.0)[:, None]
    data = rows.select(*sparse_columns(), "ys")
    shape = (len(scale), classes)

    def evaluate(points: dict) -> dict:
        models = sorted(points)
        scaled = [points[i].reshape(shape) for i in models]
        loss, known, grad = gradient_pass(data, np.concatenate([scale * v for v in scaled], 1), models, classes, n_models)
        out = {}
        for at, (i, v) in enumerate(zip(models, scaled)):
            n = max(known[at], 1.0)
            g = scale * grad[:, at * classes:(at + 1) * classes] / n + penalty * v
            out[i] = loss[at] / n + 0.5 * float((penalty * v * v).sum()), g.ravel()
        return out

    ends = descend_together(evaluate, np.zeros(shape[0] * classes), n_models, tolerance, max_steps)
    return np.stack([scale * e.reshape(shape) for e in ends])


def predict_together(rows: DataFrame, weights: np.ndarray, carry: list[str]) -> DataFrame:
    """``carry`` columns and ``pred`` (array<int>: the class under each model) of
    rows with ``features``."""
    models, _, classes = weights.shape
    sent = rows.sparkSession.sparkContext.broadcast(np.concatenate(list(weights), 1))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        w = sent.value
        for batch in batches:
            found = [np.zeros((0, models), np.int32)]
            for a, b, places, values, _, starts, some in _sliced(batch, ENTRIES):
                z = _scores(w, b - a, places, values, starts, some).reshape(b - a, models, classes)
                found.append(z.argmax(2).astype(np.int32))
            pred = np.concatenate(found)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(pred) + 1, dtype=np.int32) * models), pa.array(pred.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), lists], [*carry, "pred"])

    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carry)
    return rows.select(*carry, *sparse_columns()).mapInArrow(run, f"{types}, pred array<int>")
