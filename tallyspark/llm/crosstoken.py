"""Two tokenizers' tokens of the same texts aligned by bytes (operator 11)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import hinted, one_per_id, table
from tallyspark.session import scratch_path

#: Documents of a chunk, 2 ** CHUNK_BITS: what a bitmap spans.
CHUNK_BITS = 11
CHUNK = 1 << CHUNK_BITS
#: Bit planes of a multiplicity: a plane's number and a position share 16 bits.
PLANES = 1 << 16 - CHUNK_BITS
#: Positions of a plane from which a bitmap is smaller than their list.
DENSE = CHUNK // 16
#: Links of a chunk, from which it is ended before it has all its documents.
CHUNK_LINKS = 4_000_000
#: Distinct pieces of text whose alignment a task keeps, and the longest kept.
CACHE_PIECES, CACHE_CHARS = 250_000, 64
#: Pieces aligned together, and the characters from which fewer are.
BATCH_PIECES, BATCH_CHARS = 1000, 1 << 20
#: Ids of the second tokenizer are below this.
ID_BITS = 20
#: Characters that a text normaliser would change.
_PROBE = "\ufb01  \u2167 e\u0301 "
#: A single space between two characters that are no white space.  Neither kind
#: of tokenizer merges across it: a byte-level BPE begins a word there, and no
#: piece of the other vocabulary has its mark for a space behind another character.
_CUT = re.compile("(?<=[^\\s\u2581]) (?=[^\\s\u2581])")


# --- tokens and their bytes ------------------------------------------------------


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: bytes that print stand for
    themselves, the others for the characters from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokens:
    """Ids and bytes of a text's tokens by both libraries."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = SentencePieceProcessor(model_file=path_b)
        back = _byte_alphabet()
        self.bytes_a = {i: bytes(back[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items()
                        if all(c in back for c in t)}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode()
                        for i, p in enumerate(pieces)}
        #: Whether texts can be cut at single spaces.
        self.cuts = (str(self.a.pre_tokenizer).startswith("ByteLevel(") and self.a.normalizer is None
                     and not any("\u2581" in p.lstrip("\u2581") for p in pieces)
                     and b"".join(self.bytes_b[i] for i in self.b.encode(_PROBE)) == b" " + _PROBE.encode())
        size = 1 + max(max(self.bytes_a, default=0), max(self.bytes_b, default=0), self.a.get_vocab_size(), len(pieces))
        self.length_a, self.length_b = (np.array([len(known.get(i, b"")) for i in range(size)], np.int64)
                                        for known in (self.bytes_a, self.bytes_b))
        #: Each id with what may follow it in the groups' text.
        self.written = [f"{i}{mark}" for mark in ",|;" for i in range(size)]

    def ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of a space and each text, and of each text by the tokenizer that adds it."""
        return ([e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)],
                self.b.encode(texts, num_threads=1))


@cache
def _tokens(path_a: str, path_b: str) -> Tokens:
    return Tokens(path_a, path_b)


def aligned(a: list[int], b: list[int], bytes_a: dict[int, bytes], bytes_b: dict[int, bytes],
            data: bytes) -> tuple[str, list[int]] | None:
    """Groups as text and the linked pairs (a << ID_BITS | b) of two token
    lists over ``data``; None if either's bytes differ from it."""
    one, two = [bytes_a.get(i, b"") for i in a], [bytes_b.get(i, b"") for i in b]
    if b"".join(one) != data or b"".join(two) != data:
        return None
    groups, codes = [], []
    i = j = at_a = at_b = from_a = from_b = 0
    while i < len(a):
        at_a += len(one[i])
        i += 1
        while at_b < at_a:
            at_b += len(two[j])
            j += 1
        if at_a == at_b:  # both end here
            codes.append(a[i - 1] << ID_BITS | b[j - 1])
            groups.append(",".join(map(str, a[from_a:i])) + "|" + ",".join(map(str, b[from_b:j])))
            from_a, from_b = i, j
    return ";".join(groups), codes


def _same_bytes(ids: list[list[int]], known: dict[int, bytes], data: list[bytes]) -> bool:
    """Whether each list's tokens are its text in bytes."""
    tokens = [known.get(i, b"") for i in chain.from_iterable(ids)]
    if b"".join(tokens) != b"".join(data):
        return False
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
    last = np.cumsum(np.array(list(map(len, ids)), np.int64)) - 1
    return np.array_equal(ends[last], np.cumsum(np.array(list(map(len, data)), np.int64)))


def aligned_all(a: list[list[int]], b: list[list[int]], t: Tokens, data: list[bytes]) -> list[tuple[str, bytes] | None]:
    """``aligned`` for many texts at once, the pairs as bytes: the texts that
    both token lists give whole are laid one after the other, so that the ends
    of all their tokens are two ascending rows of numbers."""
    out: list[tuple[str, bytes] | None] = [None] * len(data)
    whole = [i for i, d in enumerate(data) if a[i] and b[i]]
    if not _same_bytes([a[i] for i in whole], t.bytes_a, data := [data[i] for i in whole]) or not _same_bytes(
            [b[i] for i in whole], t.bytes_b, data):
        kept = [k for k, i in enumerate(whole) if _same_bytes([a[i]], t.bytes_a, [data[k]])
                and _same_bytes([b[i]], t.bytes_b, [data[k]])]
        whole, data = [whole[k] for k in kept], [data[k] for k in kept]
    if not whole:
        return out
    a, b = [a[i] for i in whole], [b[i] for i in whole]
    n_a, n_b = np.array(list(map(len, a))), np.array(list(map(len, b)))
    ids_a, ids_b = np.array(list(chain.from_iterable(a)), np.int64), np.array(list(chain.from_iterable(b)), np.int64)
    size_a, size_b = t.length_a[ids_a], t.length_b[ids_b]
    if not (size_a.all() and size_b.all()):  # tokens without bytes: their place is not told by their end
        for i, x, y, d in zip(whole, a, b, data, strict=True):
            groups, codes = aligned(x, y, t.bytes_a, t.bytes_b, d)
            out[i] = groups, np.array(codes, np.int64).tobytes()
        return out
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    closes_a, closes_b = (np.isin(x, y, assume_unique=True) for x, y in ((end_a, end_b), (end_b, end_a)))
    last_a, last_b = np.flatnonzero(closes_a), np.flatnonzero(closes_b)  # of each group
    codes = ids_a[last_a] << ID_BITS | ids_b[last_b]
    # a group's tokens of the first kind go before those of the second
    group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
    text = np.empty(len(ids_a) + len(ids_b), np.int64)
    marks = len(t.written) // 3
    text[np.arange(len(ids_a)) + np.r_[0, last_b + 1][group_a]] = ids_a + marks * closes_a
    text[np.arange(len(ids_b)) + last_a[group_b] + 1] = ids_b + 2 * marks * closes_b
    written = list(map(t.written.__getitem__, text.tolist()))
    to_a = np.cumsum(n_a)
    to, links = (to_a + np.cumsum(n_b)).tolist(), (8 * np.cumsum(closes_a)[to_a - 1]).tolist()
    raw, at, link = codes.tobytes(), 0, 0
    for i, end, end_link in zip(whole, to, links, strict=True):
        out[i] = "".join(written[at:end])[:-1], raw[link:end_link]
        at, link = end, end_link
    return out


class Aligner:
    """Alignments of whole texts, each put together from those of its pieces
    between single spaces; the first ``pieces`` of them that are met are kept."""

    def __init__(self, path_a: str, path_b: str, pieces: int = CACHE_PIECES):
        self.tokens = _tokens(path_a, path_b)
        self.known: dict[str, tuple | None] = {}
        self.pieces = pieces

    def _learn(self, new: list[str]) -> dict[str, tuple | None]:
        """groups, pairs as bytes, tokens of each kind; None where the bytes differ."""
        out, t = {}, self.tokens
        at = 0
        while at < len(new):
            to, chars = at, 0
            while to < len(new) and to < at + BATCH_PIECES and chars < BATCH_CHARS:
                chars += len(new[to])
                to += 1
            own = new[at:to]
            a, b = t.ids(own)
            found = aligned_all(a, b, t, [b" " + piece.encode() for piece in own])
            out.update((piece, f and (*f, len(x), len(y))) for piece, f, x, y in zip(own, found, a, b, strict=True))
            at = to
        return out

    def align(self, texts: list[str | None]) -> list[tuple[str, bytes, int, int] | None]:
        """Of each text its groups, pairs as bytes, and tokens of each kind; None
        if it has no tokens."""
        parts, known = [], self.known
        for t in texts:
            own = t.split(" ") if t else []
            # a piece that is known has no white space at its ends
            if t and not all(p and not p[0].isspace() and not p[-1].isspace() and "\u2581" not in p
                             for p in [p for p in own if p not in known]):
                own = _CUT.split(t)
            parts.append(own if self.tokens.cuts or not t else [t])
        room = self.pieces - len(known)
        new = self._learn(list(dict.fromkeys([p for own in parts for p in own if p not in known])))
        known.update(new)
        out = []
        for own in parts:
            found = list(map(known.__getitem__, own))
            if not found or None in found:
                out.append(None)
                continue
            groups, codes, n_a, n_b = zip(*found, strict=True)
            out.append((";".join(groups), b"".join(codes), sum(n_a), sum(n_b)))
        for p in new:
            if room > 0 and len(p) <= CACHE_CHARS and p and not p[0].isspace() and not p[-1].isspace() and "\u2581" not in p:
                room -= 1
            else:
                del known[p]
        return out


@cache
def aligner(path_a: str, path_b: str) -> Aligner:
    """One of a worker's own, shared by the tasks that it runs one after the
    other: each finds the pieces that those before it have met."""
    return Aligner(path_a, path_b)


# --- pair bitmaps -----------------------------------------------------------------


def plane_entries(pos: int, codes: np.ndarray) -> np.ndarray:
    """Set bits of one document at ``pos``: code << 16 | plane << CHUNK_BITS | pos,
    one for each bit of the number of times it holds the pair ``code``."""
    code, n = np.unique(codes, return_counts=True)
    top = int(n.max()).bit_length() if len(n) else 0
    if top > PLANES:
        raise ValueError("a pair occurs too often in one document")
    return np.concatenate([code[n >> k & 1 == 1] << 16 | k << CHUNK_BITS | pos for k in range(top)] or [code])


def or_merge(parts: list[np.ndarray]) -> np.ndarray:
    """The union of sorted or unsorted sets of bits, sorted."""
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)


def containers(bits: np.ndarray) -> pd.DataFrame:
    """code, docs, links, sparse, dense of a chunk's merged bits.

    A plane of a pair's bitmap is a list of positions (16 bits each, with the
    plane; all such planes in ``sparse``) or, from ``DENSE`` positions on, a
    byte for the plane and a bitmap (in ``dense``).  docs counts the bits of the OR of a
    pair's planes, links the bits of plane k 2 ** k times.
    """
    low = (bits & 0xFFFF).astype(np.uint16)
    plane_at = np.flatnonzero(np.r_[True, np.diff(bits >> CHUNK_BITS) != 0]) if len(bits) else np.zeros(0, int)
    size = np.diff(np.r_[plane_at, len(bits)])
    code_of = bits[plane_at] >> 16
    plane = low[plane_at].astype(np.int64) >> CHUNK_BITS
    first = np.flatnonzero(np.r_[True, np.diff(code_of) != 0]) if len(code_of) else np.zeros(0, int)
    links = np.add.reduceat(size << plane, first) if len(first) else np.zeros(0, np.int64)
    docs = np.add.reduceat(size, first) if len(first) else np.zeros(0, np.int64)
    begin = np.r_[plane_at[first], len(bits)] if len(first) else np.zeros(1, int)
    raw = low.tobytes()
    sparse = [raw[2 * a:2 * b] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
    dense = [b""] * len(sparse)
    ends = np.r_[first[1:], len(plane_at)] if len(first) else first
    several = ends - first > 1
    for i in np.flatnonzero(several | (docs >= DENSE)).tolist():
        own = low[begin[i]:begin[i + 1]]
        pos = own & (CHUNK - 1)
        docs[i] = len(np.unique(pos))
        thin, thick = [], []
        for k in range(first[i], ends[i]):
            part = low[plane_at[k]:plane_at[k] + size[k]]
            if size[k] < DENSE:
                thin.append(part.tobytes())
            else:
                bitmap = np.zeros(CHUNK, np.uint8)
                bitmap[part & (CHUNK - 1)] = 1
                thick.append(bytes([int(plane[k])]) + np.packbits(bitmap).tobytes())
        sparse[i], dense[i] = b"".join(thin), b"".join(thick)
    return pd.DataFrame({"code": code_of[first], "docs": docs, "links": links, "sparse": sparse, "dense": dense})


def set_bits(sparse: list[bytes], dense: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, plane and position of every set bit of many containers."""
    low = np.frombuffer(b"".join(sparse), np.uint16)
    row = np.repeat(np.arange(len(sparse)), np.array([len(s) // 2 for s in sparse], np.int64))
    rows, planes, places = [row], [low >> CHUNK_BITS], [low & (CHUNK - 1)]
    step = 1 + CHUNK // 8
    for i, d in enumerate(dense):
        for k in range(0, len(d), step):
            at = np.flatnonzero(np.unpackbits(np.frombuffer(d, np.uint8, step - 1, k + 1)))
            rows.append(np.full(len(at), i))
            planes.append(np.full(len(at), d[k], np.uint16))
            places.append(at.astype(np.uint16))
    return np.concatenate(rows), np.concatenate(planes).astype(np.int64), np.concatenate(places).astype(np.int64)


# --- the jobs ----------------------------------------------------------------------

_DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pos int"
_POSTING = "code long, docs long, links long, sparse binary, dense binary"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
_DOC_TYPES, _POSTING_TYPES = ({c.split()[0]: _ARROW[c.split()[1]] for c in x.split(", ")} for x in (_DOC, _POSTING))
_TYPES = {"kind": pa.string(), "chunk": pa.int64(), **_DOC_TYPES, **_POSTING_TYPES}


def write_alignment(docs: DataFrame, path: str, path_a: str, path_b: str, keep_groups: bool = True) -> None:
    """Align whole texts and write to ``path`` one row per document (kind=doc)
    and, for every chunk of documents, one row per pair of ids that end
    together in it (kind=pair): compressed bitmaps of its documents.

    groups is the alignment ``a1,a2|b1;a3|b2,b3``, or only its SHA-256 unless
    ``keep_groups``.  A chunk is a number of documents that one task took one
    after the other; chunk and pos (place in it) stand for a document.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        align = aligner(path_a, path_b).align
        chunk, pos, held, links = TaskContext.get().partitionId() << 32, 0, [], 0

        def flush() -> pa.RecordBatch:
            return _batch("pair", chunk, containers(or_merge(held)))

        for batch in batches:
            texts, keys = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for i in range(0, len(texts), 200):
                out = []
                for key, found in zip(keys[i:i + 200], align(texts[i:i + 200]), strict=True):
                    if found is None:
                        out.append((key, 0, 0, 0, 0, "", pos))
                    else:
                        groups, codes, n_a, n_b = found
                        codes = np.frombuffer(codes, np.int64)
                        held.append(plane_entries(pos, codes))
                        links += len(held[-1])
                        out.append((key, n_a, n_b, groups.count(";") + 1, len(codes), groups if keep_groups
                                    else hashlib.sha256(groups.encode()).hexdigest(), pos))
                    pos += 1
                    if pos == CHUNK or links >= CHUNK_LINKS:
                        yield _batch("doc", chunk, out)
                        yield flush()
                        chunk, pos, held, links, out = chunk + 1, 0, [], 0, []
                yield _batch("doc", chunk, out)
        if held:
            yield flush()

    rows = one_per_id(docs, "doc_id", ["text"]).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows.mapInArrow(run, f"kind string, chunk long, {_DOC}, {_POSTING}").write.partitionBy("kind").parquet(path)


def _batch(kind: str, chunk: int, rows) -> pa.RecordBatch:
    """Rows of one kind in the schema of both."""
    if kind == "doc":
        own = dict(zip(_DOC_TYPES, zip(*rows, strict=True), strict=True)) if rows else {c: [] for c in _DOC_TYPES}
        n = len(rows)
    else:
        own, n = {c: rows[c].to_numpy() for c in rows}, len(rows)
    values = {"kind": [kind] * n, "chunk": [chunk] * n, **own}
    return pa.RecordBatch.from_arrays(
        [pa.array(values[c], t) if c in values else pa.nulls(n, t) for c, t in _TYPES.items()], names=list(_TYPES))


def pair_counts(postings: DataFrame) -> DataFrame:
    """a, b, docs (documents that link the pair), links (times it is linked),
    best (whether no other pair of this b has more links)."""
    counts = table(postings.groupBy("code").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links"))
                   .withColumn("b", F.col("code").bitwiseAND((1 << ID_BITS) - 1)), "counts")
    most = counts.groupBy("b").agg(F.max("links").alias("most"))
    return (counts.join(hinted(most, 100_000), "b")
            .select(F.shiftright("code", ID_BITS).alias("a"), "b", "code", "docs", "links",
                    (F.col("links") == F.col("most")).alias("best")))


def scores(postings: DataFrame, counts: DataFrame) -> DataFrame:
    """chunk, pos, n_best, count_sum of every document with a link: each pair's
    postings give its count back to its documents, as often as they link it."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, total, best, seen = None, None, None, None

        def flush() -> pd.DataFrame:
            at = np.flatnonzero(seen)
            return pd.DataFrame({"chunk": current, "pos": at, "n_best": best[at], "count_sum": total[at]})

        for batch in batches:
            chunk = batch["chunk"].to_numpy()
            edges = np.r_[0, np.flatnonzero(np.diff(chunk)) + 1, len(chunk)] if len(chunk) else [0]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if chunk[lo] != current:
                    if current is not None:
                        yield flush()
                    current, total = int(chunk[lo]), np.zeros(CHUNK, np.int64)
                    best, seen = np.zeros(CHUNK, np.int64), np.zeros(CHUNK, bool)
                own = batch.iloc[lo:hi]
                row, plane, pos = set_bits(own["sparse"].tolist(), own["dense"].tolist())
                np.add.at(total, pos, own["links"].to_numpy()[row] << plane)
                np.add.at(best, pos, own["best"].to_numpy()[row].astype(np.int64) << plane)
                seen[pos] = True
        if current is not None:
            yield flush()

    scored = postings.select("chunk", "code", "sparse", "dense").join(counts.select("code", "links", "best"), "code")
    return (scored.drop("code").repartition("chunk").sortWithinPartitions("chunk")
            .mapInPandas(run, "chunk long, pos int, n_best long, count_sum long"))


def align_tokens(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = True) -> tuple[DataFrame, DataFrame]:
    """Alignment of two tokenizers over all documents: (documents, pairs).

    Each text is encoded with a space before it by a byte-level BPE (file ``path_a``) and
    by a piece model that adds the space itself (``path_b``); byte offsets where
    tokens of both end cut them into groups, and the two tokens that end there are linked.
    Pairs of linked ids are held as an inverted index of compressed document bitmaps with
    one plane per bit of a document's number of links; OR-merged over a
    chunk's documents and popcounted they give, summed over chunks, each pair's documents and links in the whole
    corpus, and the postings return those counts to their documents.

    documents: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose
    pair has the most links of its b), count_sum (the pairs' counts, over links),
    groups (see ``write_alignment``).  pairs: see ``pair_counts``.

    Null and empty texts and those whose tokens' bytes are not the text's have no
    tokens: zeros and ''.  Rows without an id are left out, rows that repeat one count once
    (the greatest text); an empty table gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "alignment")
    write_alignment(docs, path, path_a, path_b, keep_groups)
    files = spark.read.schema(f"kind string, chunk long, {_DOC}, {_POSTING}").parquet(path)
    seen = files.filter("kind = 'doc'").select("chunk", *_DOC_TYPES)
    postings = files.filter("kind = 'pair'").select("chunk", *_POSTING_TYPES)
    counts = table(pair_counts(postings), "pairs")
    gained = table(scores(postings, counts), "scores")
    out = seen.join(gained, ["chunk", "pos"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in
                                                           ("n_best", "count_sum")), "groups")
    return out, counts.drop("code")
