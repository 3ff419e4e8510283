"""Hashed word shingles of whole texts, many texts at a time (numpy)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
#: Bytes handled at once; longer texts are cut at white space.
SLICE = 1 << 20
_ODD = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), on a copy."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _ODD)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_PLACES = mix(np.arange(1, 257, dtype=_U) * _U(0xA24BAED4963EE407)) | _U(1)


def _places(n: int) -> np.ndarray:
    """An odd random number for each of the first ``n`` places of a word."""
    global _PLACES
    if len(_PLACES) < n:
        _PLACES = mix(np.arange(1, 2 * n + 1, dtype=_U) * _U(0xA24BAED4963EE407)) | _U(1)
    return _PLACES


def _word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of at most a few MB: the sum, over its places, of
    a random number of the byte times one of the place, finalised with the length.
    The places' numbers follow no rule, so words of a rule (powers, repeats,
    Thue-Morse strings) collide no oftener than others, once in 2^64."""
    inside = ~_WHITE[buf]
    edge = np.diff(np.r_[False, inside, False].astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, _U), start
    size = end - start
    at = np.flatnonzero(inside)
    first = np.cumsum(size) - size
    place = np.arange(len(at)) - np.repeat(first, size)
    h = np.add.reduceat(_BYTE[buf[at]] * _places(int(size.max()))[place], first)
    return mix(h + size.astype(_U)), start


def words(data: bytes) -> np.ndarray:
    """Hashes of the words of one text in order, A-Z lower-cased."""
    buf = np.frombuffer(data, np.uint8)
    out, at = [], 0
    while at < len(buf):
        to = min(at + SLICE, len(buf))
        while to < len(buf) and not _WHITE[buf[to]]:  # to the end of the word
            to += 1
        out.append(_word_hashes(buf[at:to])[0])
        at = to
    return np.concatenate(out) if out else np.zeros(0, _U)


def shingle_set(w: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashed shingles of ``k`` words, sorted; the whole sequence is
    one if it has fewer words, and there is none without words."""
    if not len(w):
        return w
    size = min(k, len(w))
    h = np.zeros(len(w) - size + 1, _U)
    for j in range(size):
        h = h * _ODD + w[j:j + len(h)]
    return np.unique(mix(h + _U(size)))


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """The sets of many texts; short ones are hashed together."""
    i = 0
    while i < len(texts):
        data, j, held = [], i, 0
        while j < len(texts) and (held == 0 or held + len(texts[j] or "") < SLICE):
            data.append((texts[j] or "").encode("utf-8", "surrogatepass"))
            held += len(data[-1]) + 1
            j += 1
        if len(data) == 1:
            yield shingle_set(words(data[0]), k)
        else:
            h, start = _word_hashes(np.frombuffer(b" ".join(data), np.uint8))
            at = np.searchsorted(start, np.cumsum([0, *(len(d) + 1 for d in data)]))
            for a, b in zip(at[:-1], at[1:], strict=True):
                yield shingle_set(h[a:b], k)
        i = j
