"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits, with Latin capitals lowered. Every run of ``MATCH`` words
of a test item is a seed; a document's rolling hashes (Karp-Rabin) are joined
with the seeds, and matches that follow each other on a diagonal are one longer
match. Tiling takes the longest match that touches no marked word of item or
document, marks it, and goes on until none of ``MATCH`` words is left, so
passages count in any order and no word counts twice. A document holds an item
if tiles cover at least ``COVERAGE`` percent of the item's words.

The benchmark goes to the executors in blocks of at most ``BLOCK_BYTES`` of
text; each block is one pass over the documents, and no pair is left out.

Defined results: null or wordless texts and items match nothing; items of fewer
than ``MATCH`` words can't be found; repeated documents or items give a row
each; extra columns are ignored; an empty table on either side gives none.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.wordvec import PLAIN, release, shingles, words

MATCH, COVERAGE, BLOCK_BYTES = 3, 60, 32 << 20


class Seeds:
    """The items of one block and all their runs of MATCH words, sorted by hash."""

    def __init__(self, ids: list[int], texts: pa.Array, match: int):
        self.ids, self.size, hashes, item, at = ids, [], [], [], []
        for _, h, off in words(texts, PLAIN):
            for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                s = shingles(h[a:b], match)
                hashes.append(s)
                item.append(np.full(len(s), len(self.size)))
                at.append(np.arange(len(s)))
                self.size.append(b - a)
        order = np.argsort(np.concatenate(hashes), kind="stable") if hashes else []
        self.hash, self.item, self.at = (np.concatenate(x)[order] if hashes else np.zeros(0, t) for x, t in ((hashes, np.uint64), (item, np.int64), (at, np.int64)))

    def hits(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in s, item, place in the item) of every seed that s has."""
        if not len(self.hash) or not len(s):
            return (np.zeros(0, np.int64),) * 3
        low = np.searchsorted(self.hash, s)
        found = np.flatnonzero(self.hash[np.minimum(low, len(self.hash) - 1)] == s)
        low = low[found]
        many = np.searchsorted(self.hash, s[found], side="right") - low
        row = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        return np.repeat(found, many), self.item[row], self.at[row]


def tile(i: np.ndarray, j: np.ndarray, match: int) -> list[tuple[int, int, int]]:
    """Tiles (start in the item, start in the document, words) out of seeds at (i, j)."""
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(i) != 1) | (np.diff(j) != 1)]))
    size = np.diff(np.append(cut, len(i))) + match - 1
    heap = [(-n, a, b) for n, a, b in zip(size.tolist(), i[cut].tolist(), j[cut].tolist(), strict=True)]
    heapq.heapify(heap)
    tiles, mine, theirs = [], set(), set()
    while heap:
        n, a, b = heapq.heappop(heap)
        free = [k for k in range(-n) if a + k not in mine and b + k not in theirs]
        if len(free) == -n:
            tiles.append((a, b, -n))
            mine.update(range(a, a - n))
            theirs.update(range(b, b - n))
            continue
        run = 0  # what is left of the match goes back
        for k, x in enumerate(free):
            run += 1
            if k + 1 == len(free) or free[k + 1] != x + 1:
                if run >= match:
                    heapq.heappush(heap, (-run, a + x - run + 1, b + x - run + 1))
                run = 0
    return tiles


def found(seeds: Seeds, texts: pa.Array, match: int, coverage: int) -> Iterator[tuple[int, ...]]:
    """(row, item id, its words, words covered, tiles, longest tile, first word) of each text and item that it holds."""
    for first, h, off in words(texts, PLAIN):
        place, item, at = seeds.hits(shingles(h, match))
        doc = np.searchsorted(off, place, side="right") - 1
        inside = place + match <= off[doc + 1]
        place, item, at, doc = place[inside], item[inside], at[inside], doc[inside]
        if not len(doc):
            continue
        order = np.lexsort((item, doc))
        place, item, at, doc = place[order], item[order], at[order], doc[order]
        cuts = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(item) != 0)])).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(doc)], strict=True):
            size = seeds.size[item[a]]
            most = len(np.unique((np.unique(at[a:b])[:, None] + np.arange(match)).reshape(-1)))
            if 100 * most < coverage * size:  # tiles can't cover more than the seeds do
                continue
            tiles = tile(at[a:b], place[a:b] - off[doc[a]], match)
            got = sum(n for _, _, n in tiles)
            if 100 * got >= coverage * size:
                yield first + int(doc[a]), seeds.ids[item[a]], size, got, len(tiles), max(n for _, _, n in tiles), min(b for _, b, _ in tiles)


def _search(shared, match: int, coverage: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = shared.value
        seeds = Seeds(ids, pa.array(texts, pa.string()), match)
        for batch in batches:
            docs = batch.column(0).to_pylist()
            out = [(docs[r[0]], *r[1:]) for r in found(seeds, batch.column(1), match, coverage)]
            cols = [*zip(*out, strict=True)] or [()] * len(NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], NAMES)

    return run


def _without(shared, at: int, match: int, coverage: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = shared.value
        seeds = Seeds(ids, pa.array(texts, pa.string()), match)
        for batch in batches:
            keep = np.ones(len(batch), bool)
            keep[[r[0] for r in found(seeds, batch.column(at), match, coverage)]] = False
            yield batch.filter(pa.array(keep))
            release()

    return run


NAMES = ["doc_id", "item_id", "item_words", "matched_words", "n_tiles", "longest_tile", "first_word"]


def _blocks(items: DataFrame):
    """The benchmark as broadcast blocks of at most about BLOCK_BYTES of text."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // (BLOCK_BYTES // 2)) or 1
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        rows = part.orderBy("item_id", "text").collect()
        yield items.sparkSession.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))


def leaks(docs: DataFrame, items: DataFrame, match: int = MATCH, coverage: int = COVERAGE, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document and test item that it holds, with the tiling's figures."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema, out = ", ".join(f"{n} long" for n in NAMES), None
    for shared in _blocks(items):
        some = slim.mapInArrow(_search(shared, match, coverage), schema)
        out = some if out is None else out.unionByName(some)
    return out


def clean(docs: DataFrame, items: DataFrame, match: int = MATCH, coverage: int = COVERAGE, text: str = "text") -> DataFrame:
    """The documents that hold no test item, with their own columns; whole rows pass through the search."""
    for shared in _blocks(items):
        docs = docs.mapInArrow(_without(shared, docs.columns.index(text), match, coverage), docs.schema)
    return docs
