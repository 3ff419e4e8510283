"""Removal of repeated byte strings with suffix arrays (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import hinted, one_per_id, table, whole_text
from tallyspark.llm.shingles import mix

LENGTH = 200
#: Bytes of an anchor: every window's anchor is the least of its strings of that length, by hash.
ANCHOR = 48
#: Bytes hashed at once, and bytes of a suffix array.
SLICE, SHARD = 1 << 18, 1 << 20
#: Different segments round one anchor beyond which their windows are counted
#: by hash instead, spread over all tasks.
CROWD = 4096
BROADCAST_IDS = 200_000
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_BYTE = mix(np.arange(257, 513, dtype=_U) * _ODD)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

# --- suffix arrays ---------------------------------------------------------------


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order by key, and each entry's number within its key in that order."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.r_[True, k[1:] != k[:-1]]
    start = np.flatnonzero(first)
    return order, np.arange(len(k)) - np.repeat(start, np.diff(np.r_[start, len(k)]))


def _induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray, heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """Suffix array induced from ``lms``, the leftmost-smaller suffixes in order.

    Buckets are worked off as wholes: what a bucket's entries induce is put down
    in one step, and again for what falls into the bucket itself (as often
    as a character repeats).
    """
    sa = np.full(len(text), -1, np.int64)
    first = text[lms]
    order, nth = _grouped(first)
    count = np.bincount(first, minlength=len(heads))
    seeds = tails - count  # where each bucket's seeds begin
    sa[seeds[first[order]] + nth] = lms[order]

    head = heads.copy()
    for c in range(len(heads)):
        done = heads[c]
        while done < head[c]:
            part = sa[done:head[c]]
            done = head[c]
            _put(sa, text, small, part - 1, head, larger=True)
        if count[c]:
            _put(sa, text, small, sa[seeds[c]:tails[c]] - 1, head, larger=True)
    tail = tails.copy()
    tail[0] = heads[0]  # ends of segments stay where they are
    for c in range(len(heads) - 1, 0, -1):
        done = tails[c]
        while done > tail[c]:
            part = sa[tail[c]:done][::-1]
            done = tail[c]
            _put(sa, text, small, part - 1, tail, larger=False)
        _put(sa, text, small, sa[heads[c]:head[c]][::-1] - 1, tail, larger=False)
    return sa


def _put(sa, text, small, at, edge, larger) -> None:
    at = at[at >= 0]
    at = at[~small[at]] if larger else at[small[at] & (text[at] > 0)]
    if not len(at):
        return
    order, nth = _grouped(text[at])
    at = at[order]
    c = text[at]
    n = np.bincount(c, minlength=len(edge))
    if larger:
        sa[edge[c] + nth] = at
        edge += n
    else:
        sa[edge[c] - 1 - nth] = at
        edge -= n


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of ``text`` (integers; 0 ends each of its segments, and the
    last entry is 0), by induced sorting.  Suffixes end at the next 0; equal
    ones come in any order.

    Suffixes are classified as smaller or larger than the next; leftmost-smaller
    substrings are sorted by inducing and named; their suffixes are sorted by
    naming pairs of names again and again, each time twice as long, until all
    names differ or end; the rest is induced from them.
    """
    text = text.astype(np.int16)
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int32)))
    where = np.where(step != 0, np.arange(n - 1), n)
    where = np.minimum.accumulate(where[::-1])[::-1] if n > 1 else where
    small = np.ones(n, bool)  # smaller than the next; ends are
    ok = where < n
    small[:-1][ok] = step[where[ok]] > 0
    small[text == 0] = True
    lms = np.flatnonzero(small & np.r_[False, ~small[:-1]])
    size = np.bincount(text, minlength=int(text.max()) + 1)
    tails = np.cumsum(size)
    heads = tails - size
    sa = _induce(text, small, lms, heads, tails)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ranked = sa[is_lms[sa]]
    # names: equal for equal substrings from one leftmost-smaller place to the next
    m = len(lms)
    number = np.full(n, -1, np.int64)
    number[lms] = np.arange(m)
    length = np.ones(m, np.int64)  # an end is a substring of its own
    length[:-1] = np.where(text[lms[:-1]] == 0, 1, np.diff(lms) + 1)
    mine = length[number[ranked]]
    new = np.r_[True, mine[1:] != mine[:-1]]
    open_ = np.flatnonzero(~new)
    k = 0
    while len(open_):
        a, b = ranked[open_ - 1], ranked[open_]
        differs = text[a + k] != text[b + k]
        new[open_[differs]] = True
        k += 1
        open_ = open_[~differs & (mine[open_] > k)]
    rank = np.zeros(m + 1, np.int64)
    rank[number[ranked]] = np.cumsum(new)
    order, last = number[ranked], text[lms] == 0
    stop = np.flatnonzero(last)
    until = stop[np.searchsorted(stop, np.arange(m))]  # the end of each one's segment
    h = 1
    while rank[:m].max() < m:
        there = np.arange(m) + h
        second = np.where(there <= until, rank[np.minimum(there, m - 1)], 0)
        if not second.any():
            break
        key = rank[:m] * (m + 1) + second
        order = np.argsort(key, kind="stable")
        k = key[order]
        rank[order] = np.cumsum(np.r_[True, k[1:] != k[:-1]])
        h *= 2
    return _induce(text, small, lms[order], heads, tails)


def permuted_lcp(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place the length that its suffix shares with the one before it in
    the suffix array; compared only where that does not follow from the place
    before, which shares one more with the place before the other's."""
    n = len(text)
    before = np.empty(n, np.int64)
    before[sa[0]] = -1
    before[sa[1:]] = sa[:-1]
    prev = np.r_[-2, before[:-1]]
    j = np.maximum(before - 1, 0)
    follows = (prev == before - 1) & (before > 0) & (text[np.arange(n) - 1] == text[j]) & (np.r_[0, text[:-1]] > 0)
    ends = np.flatnonzero(text == 0)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    wide = np.zeros(n + 8, _U)
    wide[:n] = text
    wide = wide & _U(255)
    for s in (1, 2, 4):
        wide[:-s] |= wide[s:] << _U(8 * s)
    own = np.flatnonzero(~follows & (before >= 0))
    most = np.minimum(left[own], left[before[own]])
    found = np.zeros(len(own), np.int64)
    live, at = np.arange(len(own)), 0
    while len(live):
        a, b = wide[own[live] + at], wide[before[own[live]] + at]
        x = a ^ b
        same = x == 0
        low = (x & (~x + _U(1))).astype(np.float64)
        found[live] = at + np.where(same, 8, (np.frexp(low)[1] - 1) // 8)
        at += 8
        live = live[same & (most[live] > at)]
    lcp = np.zeros(n, np.int64)
    lcp[own] = np.minimum(found, most)
    base = np.maximum.accumulate(np.where(follows, -1, np.arange(n)))
    return np.maximum(lcp[base] - (np.arange(n) - base), 0)


def repeated_windows(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each segment the places whose next ``length`` bytes also start at
    another place of these segments."""
    size = sum(map(len, segments)) + len(segments)
    text = np.zeros(size, np.int16)
    at, starts = 0, []
    for s in segments:
        text[at:at + len(s)] = np.frombuffer(s, np.uint8).astype(np.int16) + 1
        starts.append(at)
        at += len(s) + 1
    sa = suffix_array(text)
    long = permuted_lcp(text, sa)[sa] >= length
    hit = np.zeros(size, bool)
    hit[sa[long]] = True
    hit[sa[np.flatnonzero(long) - 1]] = True
    return [np.flatnonzero(hit[a:a + len(s)]) for a, s in zip(starts, segments, strict=True)]


# --- anchors ---------------------------------------------------------------------


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    kept = _POWERS.get(0)
    if kept is None or len(kept[0]) < n:
        inverse = _U(pow(int(_ODD), -1, 1 << 64))
        kept = _POWERS[0] = tuple(np.multiply.accumulate(np.r_[_U(1), np.full(n - 1, m, _U)]) for m in (_ODD, inverse))
    return kept


def _hash(sums: np.ndarray, inverse: np.ndarray, start: np.ndarray, size) -> np.ndarray:
    return mix((sums[start + size] - sums[start]) * inverse[start])


def _sums(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, _U)
    np.cumsum(_BYTE[buf] * power[: len(buf)], out=sums[1:])
    return sums, inverse


def _segments(buf: np.ndarray, ends: np.ndarray, length: int, anchor: int):
    """Segments of texts that lie one after another in ``buf`` (shorter than
    2^20): text number, place of the first window, number of windows, hash of
    the anchor, hash of the segment (from the first window to the last one's
    end).

    A window is ``length`` bytes within one text; consecutive windows with the
    same anchor make a segment.  Which string is a window's anchor depends on
    its bytes alone, so equal windows have equal anchors at equal places.
    """
    n = len(buf)
    if n < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, _U),) * 2
    sums, inverse = _sums(buf)
    grams = _hash(sums, inverse, np.arange(n - anchor + 1), anchor)
    place = (grams >> _U(20) << _U(20)) | np.arange(len(grams), dtype=_U)
    width, k = length - anchor + 1, 1
    low = place
    while 2 * k <= width:
        low = np.minimum(low[:-k], low[k:])
        k *= 2
    low = np.minimum(low[: n - length + 1], low[width - k: width - k + n - length + 1])
    at = (low & _U((1 << 20) - 1)).astype(np.int64)
    s = np.arange(n - length + 1)
    who = np.searchsorted(ends, s, side="right")
    valid = s + length <= ends[np.minimum(who, len(ends) - 1)]
    s, who, at = s[valid], who[valid], at[valid]
    if not len(s):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, _U),) * 2
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (who[1:] != who[:-1])])
    count = np.diff(np.r_[new, len(s)])
    first = s[new]
    return who[new], first, count, grams[at[new]], _hash(sums, inverse, first, count + length - 1)


def anchors(rows: DataFrame, length: int, anchor: int) -> DataFrame:
    """doc_id, first, windows, key, hash of every segment of every text."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, held, who, base, size = b["doc_id"].to_numpy(), [], [], [], 0

            def flush():
                ends = np.cumsum([len(x) for x in held])
                t, first, count, key, h = _segments(np.frombuffer(b"".join(held), np.uint8), ends, length, anchor)
                begin = (ends - [len(x) for x in held])[t]
                return pd.DataFrame({"doc_id": ids[np.array(who)[t]], "first": np.array(base)[t] + first - begin,
                                     "windows": count.astype(np.int32), "key": key.view(np.int64), "hash": h.view(np.int64)})

            for i, text in enumerate(b["text"]):
                data = text.encode("utf-8", "surrogatepass")
                for a in range(0, max(1, len(data) - length + 1), SLICE - length + 1):
                    part = data[a:a + SLICE]  # windows of a long text are dealt to slices that overlap
                    if len(part) < length:
                        continue
                    if size + len(part) > SLICE and held:
                        yield flush()
                        held, who, base, size = [], [], [], 0
                    held.append(part)
                    who.append(i)
                    base.append(a)
                    size += len(part)
            if held:
                yield flush()

    return rows.mapInPandas(run, "doc_id long, first long, windows int, key long, hash long")


def _cut(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """key, hash, bytes of the segments in ``wanted`` (doc_id, first, windows,
    key, hash), cut from their texts."""
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("first", "windows", "key", "hash")).alias("own"))
    ids = hinted(wanted.select("doc_id").distinct(), BROADCAST_IDS)
    texts = rows.join(ids, "doc_id", "left_semi").select("doc_id", F.col("text").cast("binary").alias("data"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data, own in zip(b["data"], b["own"], strict=True):
                yield pd.DataFrame({
                    "key": [s["key"] for s in own], "hash": [s["hash"] for s in own],
                    "bytes": [data[s["first"]:s["first"] + s["windows"] + length - 1] for s in own]})
    return texts.join(lists, "doc_id").select("data", "own").mapInPandas(run, "key long, hash long, bytes binary")


RANGES = "key long, hash long, lo int, hi int"


def _ranges(places: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.diff(places) > 1)
    return list(zip(places[np.r_[0, cut + 1]].tolist(), places[np.r_[cut, len(places) - 1]].tolist(), strict=True))


def _by_suffix_array(segments: DataFrame, length: int) -> DataFrame:
    """Ranges of repeated windows (lo to hi) of each segment, from the suffix
    arrays of shards.  All segments round an anchor come to one task in a row;
    tasks make arrays of a few anchors each, of a bounded size."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, int, bytes]] = []
        size = 0

        def flush():
            out = []
            hits = repeated_windows([x[2] for x in held], length)
            for (key, h, _), places in zip(held, hits, strict=True):
                if len(places):
                    out += [(key, h, lo, hi) for lo, hi in _ranges(places)]
            return pd.DataFrame(out, columns=["key", "hash", "lo", "hi"])

        for b in batches:
            for key, h, data in zip(b["key"].tolist(), b["hash"].tolist(), b["bytes"], strict=True):
                if size >= SHARD and held[-1][0] != key:
                    yield flush()
                    held, size = [], 0
                held.append((key, h, data))
                size += len(data) + 1
        if held:
            yield flush()
    return segments.repartition("key").sortWithinPartitions("key").mapInPandas(run, RANGES)


def _by_window_hash(segments: DataFrame, length: int) -> DataFrame:
    """The same for anchors with a crowd of segments: each window's hash is
    counted, so no task holds all segments of an anchor."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes = b["bytes"].map(len).to_numpy()
            group = np.cumsum(sizes) // SLICE
            for g in np.unique(group):
                rows = np.flatnonzero(group == g)
                buf = np.frombuffer(b"".join(b["bytes"].iloc[rows]), np.uint8)
                sums, inverse = _sums(buf)
                count = sizes[rows] - length + 1
                lo = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                at = np.repeat(np.cumsum(sizes[rows]) - sizes[rows], count) + lo
                yield pd.DataFrame({"key": np.repeat(b["key"].to_numpy()[rows], count),
                                    "hash": np.repeat(b["hash"].to_numpy()[rows], count), "lo": lo.astype(np.int32),
                                    "window": _hash(sums, inverse, at, length).view(np.int64)})
    windows = table(segments.mapInPandas(run, "key long, hash long, lo int, window long"), "windows")
    twice = windows.groupBy("key", "window").count().filter("count > 1").drop("count")
    return windows.join(twice, ["key", "window"], "left_semi").select("key", "hash", "lo", F.col("lo").alias("hi"))


def repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, starts: the ranges (lo to hi) of places in a text's UTF-8 bytes
    whose next ``length`` bytes also start elsewhere in the corpus.  Only texts
    with such places are listed.

    Every window is put to an anchor, and windows round anchors that occur once
    are unique.  Equal segments are counted once; if a segment occurs twice all
    its windows are repeated.  Different segments round one anchor meet in a
    shard, whose suffix array (induced sorting) and permuted common prefixes
    tell which windows repeat.
    """
    rows = one_per_id(docs, "doc_id", ["text"]).filter("text is not null")
    found = table(anchors(rows, length, anchor), "anchors")
    # a table of its own, so that Spark splits the join where an anchor is hot
    again = table(found.groupBy("key").count().filter("count > 1").drop("count"), "again")
    member = table(found.join(again, "key", "left_semi"), "repeated_anchors")
    classes = table(member.groupBy("key", "hash").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "first", "windows")).alias("one")), "classes")
    several = classes.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    open_ = classes.join(several, "key").select("key", "hash", "m", "one.*")
    few, crowd = open_.filter(F.col("m") <= CROWD).drop("m"), open_.filter(F.col("m") > CROWD).drop("m")
    ranges = _by_suffix_array(_cut(rows, few, length), length)
    if not crowd.isEmpty():
        ranges = ranges.unionByName(_by_window_hash(_cut(rows, crowd, length), length))
    per = table(ranges, "ranges").groupBy("key", "hash").agg(F.collect_list(F.struct("lo", "hi")).alias("part"))
    known = table(classes.join(per, ["key", "hash"], "left").filter("n > 1 or part is not null").select(
        "key", "hash", F.when(F.col("n") == 1, F.col("part")).alias("part")), "known")
    places = member.join(known, ["key", "hash"]).select("doc_id", "first", F.explode(F.coalesce(
        "part", F.array(F.struct(F.lit(0).alias("lo"), (F.col("windows") - 1).alias("hi"))))).alias("r"))
    places = places.select("doc_id", F.struct((F.col("first") + F.col("r.lo")).alias("lo"),
                                              (F.col("first") + F.col("r.hi")).alias("hi")).alias("r"))
    return places.groupBy("doc_id").agg(F.sort_array(F.collect_list("r")).alias("starts"))


def covered(starts, length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges (start, end) that windows at sorted ranges of places cover."""
    out: list[list[int]] = []
    for r in starts:
        lo, hi = r["lo"], r["hi"] + length
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Each text without the bytes that lie in a string of ``length`` bytes that
    starts anywhere else too, its own text included; all copies go, strings are
    judged on the input, and matches never cross texts.

    Returns doc_id, n_bytes, n_removed, spans (maximal removed byte ranges,
    start and end), kept (the remaining bytes, joined).  Null or empty text has
    no bytes, texts shorter than ``length`` lose none.  Rows without an id are
    left out, rows that repeat one count once; an empty table gives no rows.
    """
    rows = one_per_id(docs, "doc_id", ["text"])
    spans = table(repeats(rows, length, anchor), "repeats")
    ids = hinted(spans.select("doc_id"), BROADCAST_IDS)
    clean = rows.join(ids, "doc_id", "left_anti").select(
        "doc_id", F.octet_length(whole_text()).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"), whole_text().cast("binary").alias("kept"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, data, starts in zip(b["doc_id"], b["data"], b["starts"], strict=True):
                gone = covered(starts, length)
                edges = [0, *(x for r in gone for x in r), len(data)]
                kept = b"".join(data[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))
                out.append((key, len(data), len(data) - len(kept), [{"start": i, "end": j} for i, j in gone], kept))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    texts = rows.join(ids, "doc_id", "left_semi").select("doc_id", F.col("text").cast("binary").alias("data"))
    cut = texts.join(spans, "doc_id").mapInPandas(
        run, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:bigint,end:bigint>>, kept binary")
    return clean.unionByName(cut)
