"""Token ids in patched frame-of-reference blocks (operator 7)."""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from string import punctuation

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import hinted, one_per_id, table, whole_text

BLOCK = 128
PERCENTILE = 90
END_ID = 2
#: Ids a segment of a file holds before the next begins.
SEGMENT_IDS = 1 << 18
#: Distinct pieces whose ids a Python worker keeps.
CACHE_PIECES = 700_000
MAGIC = b"TPF1"

# --- patched frame of reference ------------------------------------------------


def _pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of numbers (a multiple of 8) of ``width`` low bits as rows of bytes, low bits first."""
    n, m = values.shape
    if width > 16:
        bits = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(n, m, 4), axis=2, bitorder="little")[:, :, :width]
        return np.packbits(bits.reshape(n, -1), axis=1, bitorder="little")
    w = np.uint64(width)
    v = (values.astype(np.uint64) & np.uint64((1 << width) - 1)).reshape(n * m // 8, 8)
    v = v[:, 0::2] | v[:, 1::2] << w
    v = v[:, 0::2] | v[:, 1::2] << 2 * w  # four numbers each
    out = np.empty((len(v), 2), "<u8")
    out[:, 0] = v[:, 0] | (v[:, 1] << 4 * w if width < 16 else np.uint64(0))
    out[:, 1] = v[:, 1] >> (np.uint64(64) - 4 * w) if width < 16 else v[:, 1]
    return np.ascontiguousarray(out.view(np.uint8)[:, :width]).reshape(n, m * width // 8)


def _unpack_bits(raw: np.ndarray, m: int, width: int) -> np.ndarray:
    """The reverse: rows of bytes as rows of ``m`` numbers."""
    n = len(raw)
    if width > 16:
        bits = np.unpackbits(raw, axis=1, bitorder="little")[:, : m * width]
        packed = np.packbits(bits.reshape(n * m, width), axis=1, bitorder="little")
        wide = np.zeros((n * m, 4), np.uint8)
        wide[:, : packed.shape[1]] = packed
        return wide.view("<u4").reshape(n, m)
    w = np.uint64(width)
    wide = np.zeros((n * m // 8, 16), np.uint8)
    wide[:, :width] = raw.reshape(-1, width)
    word = wide.view("<u8")
    low, high = word[:, 0], word[:, 1] if width == 16 else word[:, 0] >> 4 * w | word[:, 1] << (np.uint64(64) - 4 * w)
    out = np.empty((len(word), 8), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for k in range(4):
        out[:, k] = low >> np.uint64(k) * w & mask
        out[:, k + 4] = high >> np.uint64(k) * w & mask
    return out.reshape(n, m)


def pack(ids: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> bytes:
    """One segment: header, block starts, blocks.

    Layout (little-endian): magic, u32 ids, u32 block length, u32 blocks, then
    u32 start of each block in the body and one past the last; the body.  A
    block: u32 minimum, u8 width, u16 exceptions, the differences to the minimum
    packed at that width (low bits of exceptions included), u16 place and u32
    whole difference of each exception.  Width: what ``percentile`` % of the
    block's differences fit in.
    """
    if block % 8:
        raise ValueError("a block is a multiple of 8 ids")
    ids = np.asarray(ids, np.uint32)
    n = len(ids)
    count = -(-n // block)
    if n == 0:
        return MAGIC + struct.pack("<IIII", 0, block, 0, 0)
    full = np.full(count * block, ids[-1], "<u4")
    full[:n] = ids
    grid = full.reshape(count, block)
    low = grid.min(1)
    diff = grid - low[:, None]
    k = max(0, -(-block * percentile // 100) - 1)
    width = np.frexp(np.partition(diff, k, 1)[:, k].astype(np.float64))[1].astype(np.int64)
    over = diff.astype(np.uint64) >> width[:, None].astype(np.uint64) != 0
    b, place = np.nonzero(over)
    exceptions = np.bincount(b, minlength=count)
    size = -(-block * width // 8)
    starts = np.concatenate([[0], np.cumsum(7 + size + 6 * exceptions)])
    at = starts[:-1]
    out = np.zeros(starts[-1], np.uint8)
    head = np.zeros((count, 7), np.uint8)
    head[:, :4] = low.astype("<u4").view(np.uint8).reshape(count, 4)
    head[:, 4] = width
    head[:, 5:] = exceptions.astype("<u2").view(np.uint8).reshape(count, 2)
    out[at[:, None] + np.arange(7)] = head
    for w in np.unique(width[width > 0]):  # all blocks of one width at once
        rows = np.flatnonzero(width == w)
        body = _pack_bits(diff[rows], int(w))
        out[at[rows][:, None] + 7 + np.arange(body.shape[1])] = body
    if len(b):
        rank = np.arange(len(b)) - np.concatenate([[0], np.cumsum(exceptions)])[b]
        base = at[b] + 7 + size[b]
        out[(base + 2 * rank)[:, None] + np.arange(2)] = place.astype("<u2").view(np.uint8).reshape(-1, 2)
        whole = diff[b, place].astype("<u4").view(np.uint8).reshape(-1, 4)
        out[(base + 2 * exceptions[b] + 4 * rank)[:, None] + np.arange(4)] = whole
    return MAGIC + struct.pack("<III", n, block, count) + starts.astype("<u4").tobytes() + out.tobytes()


def unpack(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids ``first`` to ``last`` (exclusive) of a segment; only the blocks that
    hold them are read, found by the index of block starts."""
    if data[:4] != MAGIC:
        raise ValueError("not a token segment")
    n, block, count = struct.unpack_from("<III", data, 4)
    last = n if last is None else min(last, n)
    if first >= last:
        return np.zeros(0, np.uint32)
    starts = np.frombuffer(data, "<u4", count + 1, 16).astype(np.int64)
    body = 16 + 4 * (count + 1)
    b0, b1 = first // block, -(-last // block)
    raw = np.frombuffer(data, np.uint8)
    at = body + starts[b0:b1]
    head = raw[at[:, None] + np.arange(7)].astype(np.int64)
    low = head[:, 0] | head[:, 1] << 8 | head[:, 2] << 16 | head[:, 3] << 24
    width, exceptions = head[:, 4], head[:, 5] | head[:, 6] << 8
    out = np.zeros((b1 - b0, block), np.int64)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        size = -(-block * int(w) // 8)
        out[rows] = _unpack_bits(raw[at[rows][:, None] + 7 + np.arange(size)], block, int(w))
    if exceptions.any():  # those of all blocks at once
        b = np.repeat(np.arange(b1 - b0), exceptions)
        rank = np.arange(len(b)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        base = (at + 7 + -(-block * width // 8))[b]
        place = raw[(base + 2 * rank)[:, None] + np.arange(2)].view("<u2")[:, 0]
        out[b, place] = raw[(base + 2 * exceptions[b] + 4 * rank)[:, None] + np.arange(4)].view("<u4")[:, 0]
    out += low[:, None]
    return out.ravel()[first - b0 * block:last - b0 * block].astype(np.uint32)


# --- tokenizer -------------------------------------------------------------------

#: The printable stand-ins of byte-level BPE for the bytes 0x80 to 0xFF (the
#: others of a letter's bytes stand for themselves).
_STAND_IN = {b: 256 + 34 + k for k, b in enumerate([*range(0x80, 0xA1), 0xAD])}


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return tok


class Encoder:
    """Ids of whole texts by the tokenizers library, special tokens' strings in a
    text as ordinary text (``encode_special_tokens``, as public_tokenizers says).

    A byte-level BPE cuts before a space that stands alone, around a line
    break that does, and between letters and marks, before it merges.  So texts
    are parted there, and each distinct piece is encoded once and its ids kept
    (the first ``pieces`` of them): words of plain letters by the library's BPE
    model itself, other pieces by its whole pipeline, many lines at a time.
    Texts with runs of spaces or line breaks, and those of any other kind of
    tokenizer, are encoded whole.
    """

    def __init__(self, path: str, pieces: int = CACHE_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks use the cores
        self.tok = _tokenizer(path)
        self.pieces = pieces
        state = str(self.tok.pre_tokenizer)
        line = self.tok.encode("\n", add_special_tokens=False).ids
        self.by_word = (state.startswith("ByteLevel(") and "add_prefix_space=False" in state
                        and self.tok.normalizer is None and len(line) == 1)
        self.line = line[0] if self.by_word else -1
        self.line_data = np.array(line, "<u4").tobytes()
        self.bare: dict[str, bytes] = {}  # pieces as they are
        self.spaced: dict[str, bytes] = {}  # pieces after a space, or with a line break instead

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _lines(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces without a line break, some thousand characters at a time."""
        out: list[bytes] = []
        for i in range(0, len(pieces), 500):
            own = pieces[i:i + 500]
            data = self._whole(["\n".join(own)])[0]
            cuts = np.flatnonzero(np.frombuffer(data, "<u4") == self.line)
            if len(cuts) != len(own) - 1:
                out += self._whole(own)
                continue
            ends = [*(4 * cuts).tolist(), len(data)]
            out += [data[a:b] for a, b in zip([0, *(x + 4 for x in ends[:-1])], ends, strict=True)]
        return out

    def _learn(self, kept: dict[str, bytes], new: list[str], space: str) -> None:
        """Add the ids of ``new`` pieces, behind ``space`` each."""
        merge, lead = self.tok.model.tokenize, "Ġ" if space else ""
        marked, other = [], []
        for w in new:
            if w in kept:
                continue
            if w.isalpha() and (w.isascii() or max(w) < "\u0250"):
                plain = w if w.isascii() else w.encode().decode("latin-1").translate(_STAND_IN)
                kept[w] = array("I", [t.id for t in merge(lead + plain)]).tobytes()
                continue
            letters = w.rstrip(punctuation)
            if letters and len(letters) < len(w) and letters.isalpha():
                marked.append((w, letters, w[len(letters):]))
            else:
                other.append(w)
        if marked:
            self._learn(kept, [x[1] for x in marked], space)
            self._learn(self.bare, [x[2] for x in marked if x[2] not in self.bare], "")
            kept.update([(w, kept[letters] + self.bare[marks]) for w, letters, marks in marked])
        if other:
            if space:
                first = [w for w in other if w[0] == "\n" and "\n" not in w[1:] and not w[1].isspace()]
                if first:
                    self._learn(self.bare, [w[1:] for w in first], "")
                    kept.update([(w, self.line_data + self.bare[w[1:]]) for w in first])
                    other = [w for w in other if w not in kept]
            broken = [w for w in other if "\n" in w]
            kept.update(zip(broken, self._whole([w if w[0] == "\n" else space + w for w in broken]), strict=True))
            other = [w for w in other if "\n" not in w]
            kept.update(zip(other, self._lines([space + w for w in other]), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_word:
            return [np.frombuffer(x, "<u4") for x in self._whole(texts)]
        full = len(self.spaced) + len(self.bare) >= self.pieces
        before = len(self.spaced), len(self.bare)
        out, get = [], self.spaced.get
        for t in texts:
            first, *rest = t.replace("\n", " \n").split(" ")
            if first in ("", "\n") or "" in rest or "\n" in rest:  # runs of white space, or some at an edge
                out.append(np.frombuffer(self._whole([t])[0], "<u4"))
                continue
            found = list(map(get, rest))
            if None in found:
                gaps, i = [], -1
                for _ in range(found.count(None)):
                    i = found.index(None, i + 1)
                    gaps.append(i)
                self._learn(self.spaced, [rest[i] for i in gaps], " ")
                for i in gaps:
                    found[i] = get(rest[i])
            if first not in self.bare:
                self._learn(self.bare, [first], "")
            out.append(np.frombuffer(self.bare[first] + b"".join(found), "<u4"))
        if full:  # what was seen first is kept; it holds the frequent pieces
            for kept, n in zip((self.spaced, self.bare), before, strict=True):
                for _ in range(len(kept) - n):
                    kept.popitem()
        return out


@cache
def encoder(path: str) -> Encoder:
    """One of a worker's own, shared by the tasks that it runs one after the
    other: each finds the pieces that those before it have met."""
    return Encoder(path)


def _groups(texts: list[str], chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of about ``chars`` characters."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


SEGMENT = ("part int, seq int, at long, ids long, open long, doc_ids array<long>, lengths array<long>, first long, "
           "data binary")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, block: int = BLOCK,
                 percentile: int = PERCENTILE, parts: int | None = None) -> None:
    """Encode whole texts and write them to ``path`` in ascending doc_id order.

    Documents are dealt to tasks by ranges of their ids; each task encodes its
    own in order, appends ``end_id`` to each, and writes segments of about
    ``SEGMENT_IDS`` ids through Spark's committed writer (a lost task is run
    again, half a file is never seen).  A segment is a row: part and seq (file
    order), at (ids of the part before it), ids, open (the document that runs on
    from the segment before), doc_ids and lengths of the documents that begin in
    it, first (where the first of them starts in it) and data (see ``pack``).
    """
    rows = one_per_id(docs, "doc_id", ["text"]).select("doc_id", whole_text().alias("text"))
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        part, seq, at, last = TaskContext.get().partitionId(), 0, 0, None
        enc = encoder(tokenizer)
        end = np.array([end_id], "<u4")
        held: list[np.ndarray] = []
        size, doc_ids, lengths, begins = 0, [], [], -1

        def flush(ids: np.ndarray) -> pd.DataFrame:
            nonlocal seq, at, last, doc_ids, lengths, begins
            first = len(ids) if begins < 0 else begins
            row = pd.DataFrame({"part": [part], "seq": [seq], "at": [at], "ids": [len(ids)],
                                "open": pd.array([last if first else None], "Int64"), "doc_ids": [doc_ids],
                                "lengths": [lengths], "first": [first], "data": [pack(ids, block, percentile)]})
            last = doc_ids[-1] if doc_ids else last
            seq, at, doc_ids, lengths, begins = seq + 1, at + len(ids), [], [], -1
            return row

        for batch in batches:
            texts, keys = batch["text"].tolist(), batch["doc_id"].tolist()
            for i, j in _groups(texts):
                for key, ids in zip(keys[i:j], enc.encode(texts[i:j]), strict=True):
                    if begins < 0:
                        begins = size
                    doc_ids.append(key)
                    lengths.append(len(ids) + 1)
                    held += [ids, end]
                    size += len(ids) + 1
                    if size >= SEGMENT_IDS:
                        flat = np.concatenate(held)
                        while len(flat) >= SEGMENT_IDS:
                            yield flush(flat[:SEGMENT_IDS])
                            flat = flat[SEGMENT_IDS:]
                        held, size = [flat], len(flat)
        if size or doc_ids:
            yield flush(np.concatenate(held))

    (rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
     .mapInPandas(segments, SEGMENT).write.parquet(path))


def read_tokens(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (array) from
    the files of ``write_tokens``; documents are put together from the segments
    they run through."""
    pieces = _pieces(spark, path, "ids array<long>", lambda ids, whole: (ids.astype(np.int64),))
    part = F.col("p.ids")
    return _glued(pieces, F.flatten(part).alias("ids"), "ids")


def token_digest(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files of ``write_tokens``."""
    def digest(ids: np.ndarray, whole: bool) -> tuple:
        data = ids.astype("<u4").tobytes()
        return (zlib.crc32(data), None) if whole else (None, data)
    # what is decoded is a number per document, and the ids of the few that are cut
    pieces = table(_pieces(spark, path, "ids_crc32 long, ids binary", digest), "pieces")
    data = F.aggregate("p", F.lit("").cast("binary"), lambda s, x: F.concat(s, x["ids"]))
    return _glued(pieces, F.crc32(data).cast("long").alias("ids_crc32"), "ids_crc32")


def _pieces(spark, path: str, columns: str, encode) -> DataFrame:
    """doc_id, start, n_tokens, seq and ``columns`` of every document, or part of
    one that runs through several segments (seq: the segment's number, -1 for a
    whole document).

    What stands before a part is a running sum over one row per part.
    """
    files = spark.read.schema(SEGMENT).parquet(path)
    parts = files.groupBy("part").agg(F.sum("ids").alias("_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_base"))
    segs = files.join(hinted(parts, 100_000), "part").select(
        (F.col("_base") + F.col("at")).alias("base"), "seq", "open", "doc_ids", "lengths", "first", "data")
    names = ["doc_id", "start", "n_tokens", "seq", *(c.split()[0] for c in columns.split(", "))]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids = unpack(row.data)
                first, base, out = int(row.first), int(row.base), []
                if first:  # the rest of a document that began before
                    out.append((int(row.open), base, first, row.seq, *encode(ids[:first], False)))
                p = first
                for key, n in zip(row.doc_ids, row.lengths, strict=True):
                    q = min(p + int(n), len(ids))
                    whole = q - p == n
                    out.append((int(key), base + p, q - p, -1 if whole else row.seq, *encode(ids[p:q], whole)))
                    p = q
                yield pd.DataFrame(out, columns=names)

    types = f"doc_id long, start long, n_tokens long, seq int, {columns}"
    return segs.mapInPandas(decode, types)


def _glued(pieces: DataFrame, value, name: str) -> DataFrame:
    """One row per document: those that lie in one segment as they are, of the
    others the parts sorted by segment."""
    whole = pieces.filter("seq < 0").select("doc_id", "start", "n_tokens", name)
    rows = F.array_sort(F.collect_list(F.struct("seq", *(c for c in pieces.columns if c not in ("doc_id", "seq")))))
    glued = pieces.filter("seq >= 0").groupBy("doc_id").agg(rows.alias("p")).select(
        "doc_id", F.col("p")[0]["start"].alias("start"),
        F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x["n_tokens"]).alias("n_tokens"), value)
    return whole.unionByName(glued)
