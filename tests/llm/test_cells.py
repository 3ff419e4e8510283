"""Cells of near vectors: the whole distance is measured for near rows only."""

import numpy as np
import pandas as pd

from tallyspark.llm import subspace


def test_cells_measure_distances_of_near_rows_only(monkeypatch):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(600, 64))
    x[1::2] = x[::2] + 0.01 * draw.normal(size=(300, 64))
    rows = pd.DataFrame({"id": range(600), "label": 0, "vec": list(x), "m": 1, "dim": 64, "axes": 0, "block": 0,
                         "cell": [[]] * 600, "chunk": np.arange(600) // 300, "lo": 0, "hi": 0})
    measured, distance = [], subspace.block_distance

    def counted(a, b):
        out = distance(a, b)
        measured.append(out.size)
        return out
    monkeypatch.setattr(subspace, "block_distance", counted)
    links = subspace.cell_links(rows, 8, 0.98)
    assert links[links.b.isna()].a.tolist() == list(range(600)) and set(links.n.dropna()) == {1}
    assert sum(measured) < 600 * 60
    # of two chunks only what lies between them
    links = subspace.cell_links(rows.assign(hi=1), 8, 0.98)
    assert links.empty
