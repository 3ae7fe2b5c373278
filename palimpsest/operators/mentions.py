"""The search for names in bodies, in tasks that hold a megabyte of text at a time.

Bodies and names are hashed by sums over their bytes, so that the hash of any stretch of a body is a difference of two
sums. At each token a body is asked for the names' heads (their first tokens, as written), then for whole names of the
lengths that a head has. A name's own hash has 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NAMED = "page_id long, size int, key long, check long, head long, lead long, bytes long, before boolean, after boolean"
HEAD = 4  # tokens of a name that are looked for first
TEXT = 1_000_000  # bytes of bodies held at once, or one longer body
TILE = 1_000_000  # stretches held at once
ROWS = 100_000  # of a batch that leaves a task
_BITS = 22  # of a hash that a first, small table is asked for

_random = np.random.default_rng(20240101)
_VALUE = _random.integers(0, 2**64, (2, 256), dtype=np.uint64)
_BASE = [int(x) | 5 for x in _random.integers(0, 2**64, 2, dtype=np.uint64)]
_TOKEN = np.zeros(256, bool)
_TOKEN[[*b"0123456789abcdefghijklmnopqrstuvwxyz"]] = True
_WORD = _TOKEN.copy()
_WORD[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ_"]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base % 2**64))
    out[:1] = 1
    return np.multiply.accumulate(out)


class Text:
    """Strings side by side: their bytes, where each begins, and where tokens begin and end."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        self.bytes = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self.at = offsets - offsets[0]
        inside = np.concatenate([[False], _TOKEN[self.bytes], [False]])
        begins = inside[1:] & ~inside[:-1]
        begins[self.at[:-1]] = inside[1:][self.at[:-1]]  # a token ends with its string
        stops = inside[:-1] & ~inside[1:]
        stops[self.at] |= inside[:-1][self.at]
        self.begin, self.stop = np.flatnonzero(begins), np.flatnonzero(stops)
        self.row = np.searchsorted(self.at, self.begin, side="right") - 1
        self._sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def hash(self, a: np.ndarray, b: np.ndarray, which: int = 0) -> np.ndarray:
        """The hashes of the stretches from a to b."""
        if which not in self._sums:
            n = len(self.bytes)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_VALUE[which][self.bytes] * _powers(_BASE[which], n), out=sums[1:])
            self._sums[which] = sums, _powers(pow(_BASE[which], -1, 2**64), n + 1)
        sums, back = self._sums[which]
        return (sums[b] - sums[a]) * back[a]

    def word(self, at: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Whether the byte is an ASCII word character of that string."""
        known = (at >= self.at[row]) & (at < self.at[row + 1])
        return known & _WORD[self.bytes[np.where(known, at, 0)]] if len(self.bytes) else known


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, size, name) -> ``NAMED``: key and check hash the name, head its first tokens; lead and bytes are the bytes before its first token and all of them, before and after tell whether its ends are word characters."""
    for batch in batches:
        for part in _parts(batch, 2):
            t = Text(part.column(2))
            first = np.searchsorted(t.row, np.arange(len(part)))
            count = np.searchsorted(t.row, np.arange(len(part)), side="right") - first
            has = np.flatnonzero(count > 0)  # others have nothing to look for
            a, b, first = t.at[has], t.at[has + 1], first[has]
            head = t.hash(t.begin[first], t.stop[first + np.minimum(count[has], HEAD) - 1])
            columns = [*(part.column(c).take(pa.array(has)) for c in (0, 1)), *(pa.array(x) for x in (t.hash(a, b).view(np.int64), t.hash(a, b, 1).view(np.int64), head.view(np.int64), t.begin[first] - a, b - a, t.word(a, has), t.word(b - 1, has)))]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in NAMED.split(", ")])


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices whose strings have about ``TEXT`` bytes."""
    size = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    i = 0
    while i < len(batch):
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + TEXT, side="right")))
        yield batch.slice(i, j - i)
        i = j


def known(rows: pa.Table) -> dict[str, np.ndarray]:
    """Names and their pages as arrays; rows: page_id, size, key, check, head, lead, bytes, before, after."""
    page, size, key, check, head, lead, length, before, after = (rows.column(i).to_numpy() for i in range(9))
    order = np.lexsort((page, key.view(np.uint64)))
    keys, first, pages = np.unique(key.view(np.uint64)[order], return_index=True, return_counts=True)
    own = order[first]
    shapes = np.unique(np.rec.fromarrays([head[own].view(np.uint64), lead[own], length[own]], names="head,lead,bytes"))
    heads, start, count = np.unique(shapes["head"], return_index=True, return_counts=True)
    out = {"keys": keys, "check": check[own].view(np.uint64), "before": before[own], "after": after[own], "size": size[own], "pages": page[order], "page": first, "many": pages}
    return out | {"heads": heads, "shape": start, "shapes": count, "lead": shapes["lead"].copy(), "bytes": shapes["bytes"].copy(), "maybe_head": _table(heads), "maybe_key": _table(keys)}


def _table(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(2**_BITS, bool)
    out[hashes >> np.uint64(64 - _BITS)] = True
    return out


def _among(h: np.ndarray, hashes: np.ndarray, maybe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in h of known hashes, and theirs among the sorted hashes."""
    at = np.flatnonzero(maybe[h >> np.uint64(64 - _BITS)])
    place = np.minimum(np.searchsorted(hashes, h[at]), len(hashes) - 1)
    same = hashes[place] == h[at]
    return at[same], place[same]


def _spread(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """start, start + 1, ..., so many of each."""
    return np.repeat(start - np.cumsum(many) + many, many) + np.arange(int(many.sum()))


def finder(sent, most: int):
    """(page_id, lower-case body) -> (from_page_id, to_page_id, size) of the names that stand in a body, its first ones by size and page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sent.value
        for batch in batches:
            for part in _parts(batch, 1) if len(names["keys"]) else ():
                pair = _found(Text(part.column(1)), names)
                yield from _links(part.column(0).to_numpy(), *np.divmod(pair, len(names["keys"])), names, most)

    return run


def _found(t: Text, names: dict[str, np.ndarray]) -> np.ndarray:
    """Bodies and the names in them, as body times the number of names plus name."""
    heads = []
    for k in range(HEAD):
        i = np.arange(max(0, len(t.begin) - k))
        i = i[t.row[i] == t.row[i + k]]
        at, head = _among(t.hash(t.begin[i], t.stop[i + k]), names["heads"], names["maybe_head"])
        heads.append((i[at], head))
    token, head = (np.concatenate(x) for x in zip(*heads, strict=True))
    many = names["shapes"][head]
    tile = np.cumsum(many) // TILE
    out = [np.zeros(0, np.int64)]
    for a, b in zip(*(np.searchsorted(tile, np.unique(tile), side=s) for s in ("left", "right")), strict=True):
        shape, at = _spread(names["shape"][head[a:b]], many[a:b]), np.repeat(token[a:b], many[a:b])
        row, left = t.row[at], t.begin[at] - names["lead"][shape]
        right = left + names["bytes"][shape]
        fits = (left >= t.at[row]) & (right <= t.at[row + 1])
        row, left, right = row[fits], left[fits], right[fits]
        at, name = _among(t.hash(left, right), names["keys"], names["maybe_key"])
        row, left, right = row[at], left[at], right[at]
        good = (t.hash(left, right, 1) == names["check"][name]) & (t.word(left - 1, row) != names["before"][name]) & (t.word(right, row) != names["after"][name])
        out.append(np.unique(row[good] * len(names["keys"]) + name[good]))
    return np.unique(np.concatenate(out))


def _links(ids: np.ndarray, row: np.ndarray, name: np.ndarray, names: dict[str, np.ndarray], most: int) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((names["pages"][names["page"][name]], -names["size"][name], row))
    row, name = row[order], name[order]
    near = np.arange(len(row)) - np.searchsorted(row, row) <= most  # each name but a body's own gives a link before those of the names after it
    row, name = row[near], name[near]
    many = np.minimum(names["many"][name], most + 1)
    to, row, size = names["pages"][_spread(names["page"][name], many)], np.repeat(row, many), np.repeat(names["size"][name], many)
    other = to != ids[row]
    to, row, size = to[other], row[other], size[other]
    order = np.lexsort((to, -size, row))
    order = order[np.arange(len(row)) - np.searchsorted(row, row[order]) < most]
    for i in range(0, len(order), ROWS):
        o = order[i : i + ROWS]
        yield pa.RecordBatch.from_arrays([pa.array(ids[row[o]]), pa.array(to[o]), pa.array(size[o])], ["from_page_id", "to_page_id", "size"])
