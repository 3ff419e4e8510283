"""Near-duplicate vectors by a subspace pigeonhole join (operator 13)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import hinted, one_per_id, table
from tallyspark.llm.components import components

#: Least cosine of a link.
COSINE = 0.98
#: Blocks that a rotated vector is split into, at most.
BLOCKS = 8
#: Rows that a task compares at once; a cell with more is dealt in chunks of so many.
#: Bringing a row to a cell costs as much as comparing it with some thousands.
CELL_ROWS = 8192
SEED = 13


def padded(dim: int) -> int:
    """The power of two that ``dim`` is filled up to."""
    return 1 << max(0, int(dim) - 1).bit_length()


def layout(dim: int, blocks: int = BLOCKS) -> tuple[int, int]:
    """Number of blocks and their width for vectors of ``dim`` components."""
    size = padded(dim)
    blocks = min(blocks, size)
    return blocks, size // blocks


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 (first by their greatest component, so nothing overflows)."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    total = np.zeros(len(x))
    for k in range(x.shape[1]):
        total += x[:, k] * x[:, k]
    return x / np.sqrt(total)[:, None]


def rotated(u: np.ndarray) -> np.ndarray:
    """Rows turned by a fixed orthogonal map: twice signs of a seeded draw, then
    the normalised Walsh-Hadamard transform.  Additions in a fixed order, so
    a row turns out the same, bit by bit, in whichever task it is computed."""
    n, dim = u.shape
    size = padded(dim)
    y = np.zeros((n, size))
    y[:, :dim] = u
    rng = np.random.Generator(np.random.PCG64(SEED))
    for _ in range(2):
        y = y * rng.choice([-1.0, 1.0], size)
        h = 1
        while h < size:
            z = y.reshape(n, size // (2 * h), 2, h)
            y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], axis=2).reshape(n, size)
            h *= 2
        y = y / math.sqrt(size)
    return y


def block_budget(dim: int, blocks: int, cosine: float) -> float:
    """A block's share of the squared distance 2 - 2 * cosine of two unit
    vectors, with room for rounding."""
    count, _ = layout(dim, blocks)
    return (2 - 2 * cosine) / count * (1 + 1e-9) + 1e-12


def block_distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances over the last axis, added up in order."""
    total = 0.0
    for k in range(x.shape[-1]):
        d = x[..., k] - y[..., k]
        total = total + d * d
    return total


def _cells(y: np.ndarray, axes: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and cells: each row's own cell, and along each axis the next
    one where it lies within ``reach`` of it.  Two rows that differ by at most ``reach``
    on every axis so meet in the cell that is the greater of their own on each axis."""
    width = 2 * reach
    home = np.floor(y[:, :axes] / width).astype(np.int64)
    near = y[:, :axes] + reach * (1 + 1e-9) >= (home + 1) * width
    rows, cell = np.arange(len(y)), home
    for k in range(axes):
        up = near[rows, k]
        more = cell[up].copy()
        more[:, k] += 1
        rows, cell = np.concatenate([rows, rows[up]]), np.concatenate([cell, more])
    return rows, cell


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in column])


def placed(classes: DataFrame, blocks: int, cosine: float, whole: bool = True) -> DataFrame:
    """Every vector once per block and cell that it may meet others in; only
    where (and a draw by its id), unless ``whole``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (dim, axes), part in batch.groupby(["dim", "axes"]):
                count, width = layout(dim, blocks)
                reach = math.sqrt(block_budget(dim, blocks, cosine))
                for i in range(0, len(part), 1000):
                    own = part.iloc[i:i + 1000].reset_index(drop=True)
                    y = rotated(unit(_matrix(own["vec"])))
                    for b in range(count):
                        rows, cell = _cells(y[:, b * width:(b + 1) * width], min(axes, width), reach)
                        for j in range(0, len(rows), 10_000):
                            out = own.iloc[rows[j:j + 10_000]]
                            names = ["label", "dim", *(("axes", "id", "m", "vec") if whole else ())]
                            yield out[names].assign(block=b, cell=list(cell[j:j + 10_000]))[order]

    kind = {f.name: f.dataType.simpleString() for f in classes.schema}
    order = ["label", "dim", "block", "cell", *(("axes", "id", "m", "vec") if whole else ())]
    types = kind | {"block": "int", "cell": "array<long>"}
    return classes.mapInPandas(run, ", ".join(f"{c} {types[c]}" for c in order))


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
    """Numbers of links that hold the components of all of them together."""
    head = list(range(n))

    def find(i: int) -> int:
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    kept = []
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        i, j = find(i), find(j)
        if i != j:
            head[max(i, j)] = min(i, j)
            kept.append(k)
    return kept


def cell_links(rows: pd.DataFrame, blocks: int, cosine: float) -> pd.DataFrame:
    """Links of the pairs that are this cell's: a, b, n.

    A pair belongs to the first block in which it is within the budget, there to the
    cell that is the greater of both own ones, and there, if the cell is dealt in
    chunks, to the deal of both rows' chunks.  Returned are, for each vector,
    how many others it is linked with (b null), and links that connect what is
    linked here (n null); not every pair.
    """
    dim, b, axes = int(rows["dim"].iloc[0]), int(rows["block"].iloc[0]), int(rows["axes"].iloc[0])
    count, width = layout(dim, blocks)
    budget = block_budget(dim, blocks, cosine)
    reach = math.sqrt(budget)
    axes = min(axes, width)
    x = _matrix(rows["vec"])
    y = rotated(unit(x))
    own = y[:, b * width:(b + 1) * width]
    home = np.floor(own[:, :axes] / (2 * reach)).astype(np.int64)
    cell = np.asarray(rows["cell"].iloc[0], np.int64)
    chunk, ids, m = rows["chunk"].to_numpy(), rows["id"].to_numpy(), rows["m"].to_numpy()
    mixed = rows["lo"].iloc[0] != rows["hi"].iloc[0]
    linked = np.zeros(len(ids), np.int64)
    heads, tails = [], []
    length = np.sqrt(np.einsum("ij,ij->i", x, x)) if np.abs(x).max() < 1e140 else None
    if length is None or length.min() < 1e-140:  # out of range for squares
        x = x / np.abs(x).max(axis=1, keepdims=True)
        length = np.sqrt(np.einsum("ij,ij->i", x, x))
    # a matrix product gives |p|^2 + |q|^2 - 2 p.q for all pairs, with some rounding (lengths are at most 1)
    square, ones = np.einsum("ij,ij->i", own, own)[:, None], np.ones((len(ids), 1))
    left, right = np.hstack([-2 * own, square, ones]), np.ascontiguousarray(np.hstack([own, ones, square]).T)
    rows_a = np.flatnonzero(chunk == rows["lo"].iloc[0]) if mixed else np.arange(len(ids))
    rows_b = np.flatnonzero(chunk == rows["hi"].iloc[0]) if mixed else rows_a
    right = right[:, rows_b]
    step = max(1, 200_000 // len(ids))  # few enough to stay in a core's cache
    for at in range(0, len(rows_a), step):
        some, start = rows_a[at:at + step], 0 if mixed else at
        near = np.flatnonzero(left[some] @ right[:, start:] <= budget + 1e-9)
        i, j = some[near // (len(rows_b) - start)], rows_b[start + near % (len(rows_b) - start)]
        if not mixed:
            i, j = i[i < j], j[i < j]
        keep = block_distance(own[i], own[j]) <= budget
        i, j = i[keep], j[keep]
        for k in range(0, len(i), 20_000):
            p, q = i[k:k + 20_000], j[k:k + 20_000]
            here = (np.maximum(home[p], home[q]) == cell[:axes]).all(axis=1)
            for e in range(b):
                if here.any():
                    here &= ~(block_distance(y[p, e * width:(e + 1) * width], y[q, e * width:(e + 1) * width]) <= budget)
            p, q = p[here], q[here]
            true = np.einsum("ij,ij->i", x[p], x[q]) / (length[p] * length[q]) >= cosine
            p, q = p[true], q[true]
            np.add.at(linked, p, m[q])
            np.add.at(linked, q, m[p])
            if len(p):
                tree = _forest(p, q, len(ids))
                heads += ids[p[tree]].tolist()
                tails += ids[q[tree]].tolist()
    met = np.flatnonzero(linked)
    return pd.DataFrame({"a": [*ids[met].tolist(), *heads], "b": pd.array([*[None] * len(met), *tails], "Int64"),
                         "n": pd.array([*linked[met].tolist(), *[None] * len(heads)], "Int64")})


def near_vectors(vectors: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links and components of vectors with the same label and a cosine of at
    least ``cosine`` (over 0), computed in double precision.

    Unit vectors at that cosine lie within a squared distance of 2 - 2 * cosine.
    They are rotated, so that the distance is spread over all axes, and split into
    blocks; by the pigeonhole principle some block of a linked pair is within its
    proportional share of that distance.  Each block is range-joined
    alone: its vectors are dealt to cells as wide as twice the range along as many axes as the
    label's size calls for, those near a border to both sides, and compared
    within cells; what is within the range there is verified on the whole
    vectors.  A pair is verified in one place only, so counts add up.

    Equal vectors of a label are one class with a multiplicity, and of the links
    of a cell only counts and a forest leave the task.  A cell with more than
    ``cell_rows`` vectors is dealt in chunks, each pair of chunks a group of its own.

    Returns vec_id, n_links (other vectors linked directly), component_id
    (smallest vec_id reachable), kept.  Vectors that are null, empty, zero or hold
    null or non-finite components, and those without a label, link with nothing;
    vectors of different lengths do not link.  Rows without vec_id are left out, rows that
    repeat one count once (the greatest vector); an empty table gives no rows.  Other columns are not read.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be over 0 and at most 1")
    rows = one_per_id(vectors, "vec_id", ["embedding", "label"], "embedding")
    vec = F.col("embedding").cast("array<double>")
    finite = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists(vec, lambda v: v != 0)
    good = rows.filter(usable).select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vec"))
    classes = table(good.groupBy("label", "vec").agg(F.min("id").alias("id"), F.count("*").alias("m")), "classes")
    # how many axes a label's vectors are cut along; only labels over one cell's size need any
    sizes = classes.groupBy("label", F.size("vec").alias("dim")).agg(F.count("*").alias("rows")).filter("rows > 1")
    cut = F.least(F.ceil(F.log(3.0, F.col("rows") / cell_rows)).cast("int"), F.lit(8))
    sizes = table(sizes.select("label", "dim", F.greatest(cut, F.lit(0)).alias("axes")), "sizes")
    dealt = classes.withColumn("dim", F.size("vec")).join(hinted(sizes, 50_000), ["label", "dim"])
    # cells with more vectors than a task compares at once are dealt in chunks by a hash of the id
    where = ["label", "dim", "block", "cell"]
    crowded = placed(dealt, blocks, cosine, whole=False).groupBy(*where).agg(F.count("*").alias("held"))
    crowded = table(crowded.filter(F.col("held") > cell_rows)
                    .select(*where, F.ceil(F.col("held") / cell_rows).cast("int").alias("chunks")), "crowded")
    spots = placed(dealt, blocks, cosine).join(hinted(crowded, 50_000), where, "left")
    spots = spots.withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    spots = spots.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1),
                                  lambda c: F.struct(F.least(c, "chunk").alias("lo"), F.greatest(c, "chunk").alias("hi"))))
    groups = spots.withColumn("deal", pairs).select("*", "deal.lo", "deal.hi").drop("deal", "chunks")
    found = groups.groupBy(*where, "lo", "hi").applyInPandas(
        lambda own: cell_links(own, blocks, cosine), "a long, b long, n long")
    found = table(found, "found")
    counted = found.filter("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    comp = components(found.filter("b is not null").select("a", "b"))
    # classes of several vectors: their members follow the class's smallest id
    several = classes.filter("m > 1").select("label", "vec", F.col("id").alias("rep"), "m")
    member = table(good.join(several, ["label", "vec"]).select("id", "rep", "m"), "members")
    out = rows.select(F.col("vec_id").alias("id")).join(member, "id", "left").withColumn("rep", F.coalesce("rep", "id"))
    out = (out.join(counted.withColumnRenamed("id", "rep"), "rep", "left")
           .join(comp.withColumnRenamed("id", "rep"), "rep", "left"))
    links = F.coalesce("n", F.lit(0)) + F.coalesce(F.col("m") - 1, F.lit(0))
    return out.select(F.col("id").alias("vec_id"), links.alias("n_links"), F.coalesce("comp", "rep").alias("component_id"))\
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
