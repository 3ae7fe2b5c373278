"""Pre-tokens of the public byte-level pattern by array arithmetic, and a table of encoded pieces.

``public_tokenizers.PATTERN`` splits a text into contractions, runs of letters,
of numbers and of other signs (each with one space before it, if there is one)
and runs of white space. All boundaries depend on a code point's class and its
neighbours, so they are found for a whole batch at once. Each distinct piece is
then encoded once and looked up afterwards by a 64-bit hash of its code points.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa

from palimpsest.llm.wordvec import buffers, span_hashes

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
CHUNK = 1 << 19
MAX_PIECES = 400_000
#: Code points with the White_Space property.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def classes() -> np.ndarray:
    kind = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[WHITE] = SPACE
    return out


def piece_starts(c: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions where a piece begins. c: code points; first: True where a text begins."""
    n = len(c)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[c]
    begin = first.copy()
    begin[1:] |= kind[1:] != kind[:-1]
    begin[0] = True
    # white space before something else: its last character stands apart, or leads the next piece if it is U+0020
    before = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:])
    begin[before] = True
    begin[before[c[before] == 0x20] + 1] = False
    # contractions, where a single apostrophe begins a piece
    q = np.flatnonzero((c == 0x27) & begin)
    if len(q):
        pad = np.concatenate([c, [0, 0]])
        edge = np.concatenate([first, [True, True]])
        one, two = np.where(edge[q + 1], 0, pad[q + 1]), np.where(edge[q + 1] | edge[q + 2], 0, pad[q + 2])
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        begin[q[short | long] + 1] = False
        after = np.concatenate([q[short] + 2, q[long] + 3])
        begin[after[after < n]] = True
    return np.flatnonzero(begin)


def pieces(texts: pa.Array) -> Iterator[tuple[int, str, np.ndarray, np.ndarray, np.ndarray]]:
    """(first document, its run's text, piece starts, their hashes, n + 1 piece offsets of the documents)."""
    data, off = buffers(texts)
    i, n = 0, len(off) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + CHUNK, side="right")) - 1))
        part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        try:
            text = part.tobytes().decode()
            at = np.zeros(len(part) + 1, np.int64)
            np.cumsum((part & 0xC0) != 0x80, out=at[1:])
            at = at[o]
        except UnicodeDecodeError:
            each = [part[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(o[:-1], o[1:], strict=True)]
            text, at = "".join(each), np.cumsum([0, *map(len, each)])
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        first = np.zeros(len(c) + 1, dtype=bool)
        first[at] = True
        starts = piece_starts(c, first[:-1])
        last = np.append(starts[1:], len(c)) - 1 if len(starts) else starts
        yield i, text, starts, span_hashes(c.astype(np.uint64) + np.uint64(1), starts, last), np.searchsorted(starts, at)
        i = j


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start[0]:start[0] + size[0]], flat[start[1]:...], ... in one array."""
    ahead = np.cumsum(size) - size
    return flat[np.repeat(start - ahead, size) + np.arange(int(size.sum()))]


def in_order(places: Sequence[int], flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists that follow one another in flat, put in the order of their places from 0 on, and their sizes."""
    order = np.empty(len(size), np.int64)
    order[np.asarray(places, np.int64)] = np.arange(len(size))
    size = size.astype(np.int64)
    return gather(flat, (np.cumsum(size) - size)[order], size[order]), size[order]


Columns = list[tuple[np.ndarray, np.ndarray]]


class PieceTable:
    """Encoded pieces by hash; at most MAX_PIECES and those of one call are kept.

    ``encode`` gets distinct pieces and returns columns, each as one flat array
    and the number of its values that belong to each piece.
    """

    def __init__(self, encode: Callable[[list[str]], Columns]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.keys, self.slot, self.flat, self.start, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], [], []

    def __call__(self, text: str, starts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The slot of each piece; values of column k are flat[k][start[k][slot]:...]."""
        return self.learn([(text, starts, hashes)])[0]

    def learn(self, runs: Sequence[tuple[str, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """The same for runs (text, piece starts, their hashes), whose new pieces are encoded in one call."""
        if len(self.keys) > MAX_PIECES:
            self.clear()
        words, fresh, found = [], [], []
        for text, starts, hashes in runs:
            unique, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            found.append((unique, inverse.astype(np.int32)))
            new = np.flatnonzero(~self._among(self.keys, unique))
            for seen in fresh:
                new = new[~self._among(seen, unique[new])]
            ends = np.append(starts[1:], len(text))
            words += [text[a:b] for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)]
            fresh.append(unique[new])
        if words:
            self._add(words, np.concatenate(fresh))
        return [self.slot[np.searchsorted(self.keys, unique)][inverse] for unique, inverse in found]

    def _add(self, words: list[str], hashes: np.ndarray) -> None:
        for k, (flat, size) in enumerate(self.encode(words)):
            if len(self.flat) == k:
                self.flat.append(flat[:0])
                self.start.append(np.zeros(0, np.int64))
                self.size.append(np.zeros(0, np.int64))
            self.start[k] = np.concatenate([self.start[k], len(self.flat[k]) + np.cumsum(size) - size])
            self.size[k] = np.concatenate([self.size[k], size])
            self.flat[k] = np.concatenate([self.flat[k], flat])
        keys = np.concatenate([self.keys, hashes])
        order = np.argsort(keys, kind="stable")
        self.keys, self.slot = keys[order], np.concatenate([self.slot, len(self.keys) + np.arange(len(words))])[order]

    @staticmethod
    def _among(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Which of some are among sorted keys."""
        where = np.searchsorted(keys, some)
        out = np.zeros(len(some), bool)
        inside = where < len(keys)
        out[inside] = keys[where[inside]] == some[inside]
        return out

    def values(self, k: int, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Column k of the given slots: all values, and how many each has."""
        if not len(slots):
            return (self.flat[k][:0] if self.flat else np.zeros(0, np.uint32)), np.zeros(0, np.int64)
        size = self.size[k][slots]
        return gather(self.flat[k], self.start[k][slots], size), size
