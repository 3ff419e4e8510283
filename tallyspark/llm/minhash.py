"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash
signatures (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import hinted, one_per_id, table
from tallyspark.llm.components import components
from tallyspark.llm.shingles import mix, shingle_sets

SHINGLE = 5
PERCENT = 80
#: Signature: CHUNKS x WIDTH positions of 16 bits; ERRORS positions of a chunk may differ.
CHUNKS, WIDTH, ERRORS = 14, 4, 1
#: Positions in which two signatures may differ at most if their sets are to be
#: compared: all that the chunks guarantee to find (a pair of similarity 0.8
#: differs in more with a probability of 4e-7).
DISTANCE = CHUNKS * (ERRORS + 1) - 1
#: Members from which all of a bucket are compared with its centre, if any is in another component.
CROWD = 8
#: Ids up to which the documents to compare are broadcast to their texts; above, texts are shuffled.
BROADCAST_IDS = 200_000
_U = np.uint64


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    s = mix(np.arange(1, 2 * n + 1, dtype=_U) * _U(0xD1B54A32D192ED03))
    return s[:n], s[n:] | _U(1)


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """(len(sets), n) numbers: the low 16 bits of each of n minimum hashes.  Every
    set has at least one member."""
    at = np.cumsum([0, *(len(s) for s in sets)])[:-1]
    flat = np.concatenate(sets)
    out = np.zeros((len(sets), n), np.uint16)
    for j, (x, m) in enumerate(zip(*_seeds(n), strict=True)):
        h = (flat ^ x) * m
        h ^= h >> _U(32)
        out[:, j] = (mix(np.minimum.reduceat(h, at)) & _U(0xFFFF)).astype(np.uint16)
    return out


def chunk_keys(sig: np.ndarray, chunks: int, width: int, errors: int) -> np.ndarray:
    """For each signature the keys of its chunks: every choice of
    width - errors positions of a chunk, hashed with the chunk's number and the
    choice.  Two signatures share a key exactly when (but for hash collisions) some
    chunk differs in at most ``errors`` positions; by pigeonhole that holds for
    every pair that differs in fewer than chunks * (errors + 1)."""
    keep = list(combinations(range(width), width - errors))
    out = np.zeros((len(sig), chunks * len(keep)), _U)
    wide = sig.astype(_U)
    for c in range(chunks):
        for i, places in enumerate(keep):
            key = np.full(len(sig), c * len(keep) + i + 1, _U)
            for j, p in enumerate(places):  # three positions and the choice fill a key without loss
                key = (key if j % 3 or not j else mix(key)) << _U(16) | wide[:, c * width + p]
            out[:, c * len(keep) + i] = mix(key)
    return out.view(np.int64)


def _differing(a: Column, b: Column, longs: int) -> Column:
    """Positions (16 bits each) in which two packed signatures differ."""
    low = F.lit(0x0001000100010001)
    total = F.lit(0)
    for i in range(longs):
        x = a[i].bitwiseXOR(b[i])
        for s in (8, 4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, s))
        total = total + F.bit_count(x.bitwiseAND(low))
    return total


def describe(rows: DataFrame, shingle: int, chunks: int, width: int, errors: int) -> DataFrame:
    """doc_id, n, h1, h2 (a 128-bit hash of the set), sig, keys."""
    n = chunks * width
    longs = -(-n // 4)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, ids = [], []

            def flush():
                full = [i for i, s in enumerate(held) if len(s)]
                sig = np.zeros((len(held), longs * 4), np.uint16)
                keys = [None] * len(held)
                if full:
                    found = signatures([held[i] for i in full], n)
                    sig[full, :n] = found
                    for i, k in zip(full, chunk_keys(found, chunks, width, errors), strict=True):
                        keys[i] = k
                return pd.DataFrame({
                    "doc_id": ids, "n": [len(s) for s in held],
                    "h1": [int(np.bitwise_xor.reduce(s).view(np.int64)) if len(s) else 0 for s in held],
                    "h2": [int(np.add.reduce(mix(s)).view(np.int64)) if len(s) else 0 for s in held],
                    "sig": list(sig.view(np.int64)), "keys": keys})

            size = 0
            for key, s in zip(batch["doc_id"], shingle_sets(batch["text"].tolist(), shingle), strict=True):
                held.append(s)
                ids.append(key)
                size += len(s)
                if size > 400_000:
                    yield flush()
                    held, ids, size = [], [], 0
            if held:
                yield flush()

    return rows.select("doc_id", "text").mapInPandas(
        run, "doc_id long, n long, h1 long, h2 long, sig array<long>, keys array<long>")


def full_sets(rows: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["doc_id"].tolist()
            for i in range(0, len(ids), 200):
                sets = shingle_sets(batch["text"].tolist()[i:i + 200], shingle)
                yield pd.DataFrame({"id": ids[i:i + 200], "members": [s.view(np.int64) for s in sets]})
    return rows.select("doc_id", "text").mapInPandas(run, "id long, members array<long>")


def compared(pairs: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) with the sizes of their full sets, the number of shingles
    that they share, the shingles that b has beyond a (extra), and which of a's
    sorted shingles b has (bits, 64 a number)."""
    ids = table(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "compared")
    sets = table(full_sets(rows.join(hinted(ids, BROADCAST_IDS), "doc_id", "left_semi"), shingle), "sets")
    both = (pairs.join(sets.select(F.col("id").alias("b"), F.col("members").alias("mb")), "b")
            .join(sets.select(F.col("id").alias("a"), F.col("members").alias("ma")), "a"))
    return both.select("a", "b", "ma", "mb").mapInPandas(
        _shared, "a long, b long, n_a int, n_b int, common int, extra array<long>, bits array<long>")


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for i in range(0, len(batch), 200):
            own, out = batch.iloc[i:i + 200], []
            for a, b, ma, mb in own[["a", "b", "ma", "mb"]].itertuples(index=False):
                inside = np.isin(ma, mb, assume_unique=True)
                extra = np.setdiff1d(mb, ma, assume_unique=True)
                bits = np.zeros(-(-len(ma) // 64) * 8, np.uint8)
                packed = np.packbits(inside, bitorder="little")
                bits[:len(packed)] = packed
                out.append((a, b, len(ma), len(mb), int(inside.sum()), extra, bits.view(np.int64)))
            yield pd.DataFrame(out, columns=["a", "b", "n_a", "n_b", "common", "extra", "bits"])


def linked(common: Column, percent: int) -> Column:
    """Whether sets of n_a and n_b shingles, ``common`` of them shared, are similar."""
    return 100 * common >= percent * (F.col("n_a") + F.col("n_b") - common)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, chunks: int = CHUNKS,
                    width: int = WIDTH, errors: int = ERRORS, distance: int = DISTANCE) -> DataFrame:
    """Connected components of documents with similar shingle sets.

    Documents with equal sets are one class, represented by its smallest id.
    The representatives' b-bit signatures are cut into chunks; each chunk is
    indexed under every choice of positions that remains when ``errors`` of them
    are wrong, so every pair that differs in fewer than chunks * (errors + 1)
    positions shares a bucket.  With the defaults a pair of similarity 0.8 shares
    none with a probability below 1e-9, and pairs within ``distance`` always share one.

    A bucket's members are first compared with its centre, the member that
    meets most others over all its buckets.  That puts a group of copies of one
    text together without listing its pairs.  What is then in another component
    than the centre is compared with the bucket's members of other components,
    unless their sizes or their signatures rule a link out.  Two sets that were
    both compared with the centre are compared there and then, on what of
    the centre's set both have and on what they have beyond it, which together
    is all that they share; only links are listed.  In a bucket of ``CROWD`` members
    and more that is so for all; in a smaller one a pair of which one set was not
    compared with the centre is listed, in one of the buckets it shares, and its
    full sets are compared.  So what is listed grows with the members of all buckets, not
    with the square of one's, no pair within a component is listed, and
    none across two that could be a link is left out.

    Returns doc_id, n_shingles (size of the set), component_id (smallest id
    reachable), kept.  Null, empty or blank text has no shingles and is linked
    with nothing.  Rows without an id are left out, rows that repeat one count
    once; an empty table gives no rows.
    """
    longs = -(-chunks * width // 4)
    rows = one_per_id(docs, "doc_id", ["text"])
    seen = table(describe(rows, shingle, chunks, width, errors), "described")
    # small tables of their own, so that Spark splits the joins where a group is hot
    classes = table(seen.filter("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep")), "classes")
    member = table(seen.filter("n > 0").select("doc_id", "n", "h1", "h2").join(classes, ["n", "h1", "h2"])
                   .select("doc_id", "rep"), "members")
    reps = member.filter("doc_id = rep").select("doc_id")
    size = table(seen.select("doc_id", "n", "sig").join(reps, "doc_id", "left_semi"), "sizes")
    index = table(seen.select("doc_id", "keys").join(reps, "doc_id", "left_semi")
                  .select(F.posexplode("keys").alias("k", "key"), F.col("doc_id").alias("id")), "index")
    shared = table(index.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "shared")
    near = table(index.join(shared, "key"), "near")
    meets = near.groupBy("id").agg(F.sum("m").alias("met"))
    near = near.join(meets, "id").select("key", "k", "m", "id", F.struct("met", (-F.col("id")).alias("id")).alias("rank"))
    centre = table(near.groupBy("key").agg((-F.max("rank")["id"]).alias("centre")), "centres")
    placed = table(near.drop("rank").join(centre, "key"), "placed")
    stars = placed.filter("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()

    a = size.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    b = size.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    stars = stars.join(a, "a").join(b, "b").filter(_alike(percent, distance, longs)).select("a", "b")
    tested = table(compared(table(stars, "stars"), rows, shingle), "tested")
    links = tested.filter(linked(F.col("common"), percent)).select("a", "b")
    comp = components(links)

    # buckets with members in another component than the centre
    home = comp.select(F.col("id").alias("centre"), F.col("comp").alias("home"))
    there = (placed.join(comp, "id", "left").join(home, "centre", "left")
             .withColumn("comp", F.coalesce("comp", "id")).withColumn("home", F.coalesce("home", "centre")))
    there = table(there.join(there.filter("comp <> home").select("key").distinct(), "key", "left_semi"), "mixed")
    # in large ones also those that signatures told from the centre: a comparison each, not one for each two of them
    beyond = there.filter((F.col("m") >= CROWD) & (F.col("id") != F.col("centre"))).select(
        F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    beyond = table(beyond.join(tested.select("a", "b"), ["a", "b"], "left_anti"), "beyond")
    more = []
    if not beyond.isEmpty():
        beyond = table(compared(beyond, rows, shingle), "beyond_tested")
        tested = tested.unionByName(beyond)
        more.append(beyond.filter(linked(F.col("common"), percent)).select("a", "b"))

    # what each member of a bucket shares with its centre, and has beyond it; null if that was ruled out
    with_centre = tested.select(F.col("a").alias("centre"), F.col("b").alias("id"), "common", "extra", "bits")
    whole = F.ceil(F.col("n") / 64).cast("int")
    there = table(there.join(with_centre, ["centre", "id"], "left")
                  .join(seen.select(F.col("doc_id").alias("id"), "n", "sig", "keys"), "id")
                  .withColumn("common", F.when(F.col("id") == F.col("centre"), F.col("n")).otherwise(F.col("common")))
                  .withColumn("extra", F.when(F.col("id") == F.col("centre"), F.array().cast("array<long>"))
                              .otherwise(F.col("extra")))
                  .withColumn("bits", F.when(F.col("id") == F.col("centre"), F.array_repeat(F.lit(-1).cast("long"), whole))
                              .otherwise(F.col("bits"))), "there")
    cols = ("id", "comp", "n", "sig", "keys", "common", "extra", "bits")
    x = there.filter("comp <> home").select("key", "k", *(F.col(c).alias(f"{c}_a") for c in cols))
    y = there.select(F.col("key").alias("key_b"), (F.col("comp") == F.col("home")).alias("at_home"),
                     *(F.col(c).alias(f"{c}_b") for c in cols))
    unknown = F.col("common_a").isNull() | F.col("common_b").isNull()
    inside = F.least("common_a", "common_b")
    outside = F.least(F.col("n_a") - F.col("common_a"), F.col("n_b") - F.col("common_b"))
    possible = unknown | linked(inside + outside, percent)
    # what both share with the centre, and beyond it: all that they share
    both_have = F.aggregate(F.zip_with("bits_a", "bits_b", lambda p, q: F.bit_count(p.bitwiseAND(q))), F.lit(0), lambda s, x: s + x)
    likely = unknown | linked(both_have + F.size(F.array_intersect("extra_a", "extra_b")), percent)
    # the first key that both have is this bucket's
    once = F.expr("not exists(slice(zip_with(keys_a, keys_b, (p, q) -> p = q), 1, k), e -> e)")
    across = ((F.col("comp_a") != F.col("comp_b")) & (F.col("at_home") | (F.col("id_a") < F.col("id_b")))
              & possible & _alike(percent, distance, longs) & likely & once)
    other = table(x.join(y, (F.col("key") == F.col("key_b")) & across).select(
        F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), unknown.alias("open")), "others")
    known = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = table(other.filter("open").select("a", "b").distinct().join(known, ["a", "b"], "left_anti"), "rest")
    more.append(other.filter("not open").select("a", "b"))
    if not rest.isEmpty():
        more.append(compared(rest, rows, shingle).filter(linked(F.col("common"), percent)).select("a", "b"))
    more = table(reduce(DataFrame.unionByName, more), "more")
    if not more.isEmpty():
        comp = components(links.unionByName(more))
    return (seen.select("doc_id", "n").join(member, "doc_id", "left")
            .join(comp.withColumnRenamed("id", "rep"), "rep", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.coalesce("comp", "rep", "doc_id").alias("component_id"))
            .withColumn("kept", F.col("doc_id") == F.col("component_id")))


def _alike(percent: int, distance: int, longs: int) -> Column:
    """Sizes and signatures (n_a, sig_a, n_b, sig_b) that allow a link."""
    a, b = F.col("n_a"), F.col("n_b")
    return ((100 * F.least(a, b) >= percent * F.greatest(a, b))
            & (_differing(F.col("sig_a"), F.col("sig_b"), longs) <= distance))
