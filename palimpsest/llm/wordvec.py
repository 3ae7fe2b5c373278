"""Words and word shingles of whole texts as 64-bit hashes, by array arithmetic.

A word is a longest run of bytes outside 0x20 and 0x09-0x0D, with A-Z lowered.
Its hash is a polynomial of its bytes, cut out of one running sum over the
batch, then mixed. Texts are never cut: a batch is split between documents.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 21  # bytes of text handled at once, unless one text is longer
_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint64) + 1
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Blanks if punctuation parts words too: every ASCII byte but letters and digits.
PLAIN = np.array([not (chr(i).isalnum() or i >= 0x80) for i in range(256)])
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def release() -> None:
    """Gives freed memory back to the system, so that a worker that goes on with other work is as small as a new one."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim:
        trim(0)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, mod 2**64."""
    if len(_powers.get("up", ())) < n:
        size = (n | 0xFFFF) + 1  # as many as were needed so far, not those of the largest run
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string array; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if offsets else np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8), off


def chunks(off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of documents of about CHUNK bytes."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, off: np.ndarray, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and last positions of the words, and n + 1 word offsets of the documents."""
    solid = ~blank[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[off] = True
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1] | first[1:-1]
    end[:-1] &= ~solid[1:] | first[1:-1]
    starts, last = np.flatnonzero(begin), np.flatnonzero(end)
    return starts, last, np.searchsorted(starts, off)


def span_hashes(values: np.ndarray, starts: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of values[start..last], each value a 64-bit number above 0."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[last + 1] - total[starts]) * down[starts])


def words(texts: pa.Array, blank: np.ndarray = _BLANK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, word hashes, n + 1 word offsets) for runs of documents."""
    data, off = buffers(texts)
    for i, j in chunks(off):
        part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        if not len(part):
            yield i, np.zeros(0, np.uint64), np.zeros(j - i + 1, np.int64)
            continue
        starts, last, woff = word_spans(part, o, blank)
        values = _LOWER[part]
        if blank is PLAIN:  # the capitals of Latin-1 are lowered as well
            lead = np.flatnonzero(part[:-1] == 0xC3)
            tail = part[lead + 1]
            values[lead[(tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)] + 1] += np.uint64(32)
        yield i, span_hashes(values, starts, last), woff


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words, at each word that has k - 1 after it."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    s = h[:n].copy()
    for j in range(1, k):
        s = mix(s * _M2 + h[j : j + n])
    return s


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingles; fewer than k words count as one shingle, none as no shingle."""
    for _, h, off in words(texts):
        s = shingles(h, k)
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(s[a : b - k + 1])
            elif b > a:
                one = np.array([b - a], dtype=np.uint64)
                for x in h[a:b]:
                    one = mix(one * _M1 + x)
                yield one
            else:
                yield np.zeros(0, np.uint64)
