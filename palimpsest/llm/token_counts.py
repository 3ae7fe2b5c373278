"""Edit-aware token counts: a segment tree of pre-tokens for each document.

A tree's leaves hold runs of pre-tokens (characters and tokens of each); its
inner nodes hold the sums. An edit replaces characters ``[start, stop)``. Only
the pre-tokens from shortly before the edit up to the first boundary behind it
that the old text had as well are cut and encoded again, and the sums on their
leaves' paths are updated. Pre-tokens are matched from left to right and look
two characters ahead at most, so what ends three characters before the edit
stands, and after a common boundary everything is as before.

Defined results: a null text is an empty one; positions are clipped to the text;
a null replacement deletes; null or no edits leave the counts; edits apply in
order of ``seq``, those with a null or unknown document id are ignored; repeated
rows are counted one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.pretok import PieceTable, pieces

LEAF, AHEAD = 64, 3


class Counter:
    """Tokens of pre-tokens under a rank file, by the tiktoken library; each distinct one is encoded once."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        import tiktoken

        from palimpsest.llm.bpe_duckdb import read_ranks

        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.coding = tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
        self.pieces = PieceTable(self._columns)

    def count(self, piece: str) -> int:
        return len(self.coding.encode_ordinary(piece))

    def _columns(self, words: list[str]):
        return [(np.fromiter(map(self.count, words), np.int32), np.ones(len(words), np.int64))]

    def leaves(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Characters and tokens of each text's pre-tokens."""
        for _, text, starts, hashes, off in pieces(texts):
            tokens, _ = self.pieces.values(0, self.pieces(text, starts, hashes))
            size = np.diff(np.append(starts, len(text)))
            for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                yield size[a:b], tokens[a:b]


class Tree:
    """Sums of characters and tokens over runs of pre-tokens."""

    def __init__(self, text: str, chars: list[int], tokens: list[int]):
        self.text = text
        self._build([(chars[i : i + LEAF], tokens[i : i + LEAF]) for i in range(0, len(chars), LEAF)] or [([], [])])

    def _build(self, leaves: list[tuple[list[int], list[int]]]) -> None:
        self.leaves = leaves
        self.half = 1 << max(0, (len(leaves) - 1).bit_length())
        self.chars, self.tokens = [0] * (2 * self.half), [0] * (2 * self.half)
        for i, (c, t) in enumerate(leaves):
            self.chars[self.half + i], self.tokens[self.half + i] = sum(c), sum(t)
        for i in range(self.half - 1, 0, -1):
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def pairs(self) -> tuple[list[int], list[int]]:
        return [x for c, _ in self.leaves for x in c], [x for _, t in self.leaves for x in t]

    def find(self, at: int) -> tuple[int, int, int]:
        """(leaf, pre-token in it, its first character) that holds a character, or the end."""
        node, ahead = 1, 0
        while node < self.half:
            node *= 2
            if at - ahead >= self.chars[node] and self.chars[node + 1]:
                ahead += self.chars[node]
                node += 1
        leaf = node - self.half
        for k, c in enumerate(self.leaves[leaf][0]):
            if at < ahead + c:
                return leaf, k, ahead
            ahead += c
        return leaf, len(self.leaves[leaf][0]), ahead

    def edit(self, start: int, stop: int, new: str, counter: Counter) -> int:
        """Applies one edit and returns how many pre-tokens it encoded."""
        n = len(self.text)
        start = min(max(start, 0), n)
        stop = min(max(stop, start), n)
        shift = len(new) - (stop - start)
        leaf, k, begin = self.find(max(0, start - AHEAD))
        self.text = self.text[:start] + new + self.text[stop:]
        old_leaf, old_k, old_at = leaf, k, begin  # the next old boundary, as it was
        safe = start + len(new)
        chars, tokens, at = [], [], begin
        synced = at >= len(self.text) and old_at + shift >= len(self.text)
        for m in counter.pattern.finditer(self.text, begin):
            chars.append(m.end() - m.start())
            tokens.append(counter.count(m.group()))
            at = m.end()
            if at >= safe:
                while old_leaf < len(self.leaves) and old_at + shift < at:
                    if old_k >= len(self.leaves[old_leaf][0]):
                        old_leaf, old_k = old_leaf + 1, 0
                        continue
                    old_at += self.leaves[old_leaf][0][old_k]
                    old_k += 1
                if old_at + shift == at and old_at >= stop:
                    synced = True
                    break
        if not synced or at >= len(self.text):
            old_leaf, old_k = len(self.leaves) - 1, len(self.leaves[-1][0])
        old_leaf = min(old_leaf, len(self.leaves) - 1)
        head, tail = self.leaves[leaf], self.leaves[old_leaf]
        merged = (head[0][:k] + chars + tail[0][old_k:], head[1][:k] + tokens + tail[1][old_k:])
        if old_leaf - leaf > 8 or len(merged[0]) > 8 * LEAF:
            cut = [(merged[0][i : i + LEAF], merged[1][i : i + LEAF]) for i in range(0, len(merged[0]), LEAF)] or [([], [])]
            self._build(self.leaves[:leaf] + cut + self.leaves[old_leaf + 1 :])
            return len(chars)
        for i in range(leaf, old_leaf + 1):
            self._put(i, merged if i == leaf else ([], []))
        return len(chars)

    def _put(self, i: int, leaf: tuple[list[int], list[int]]) -> None:
        self.leaves[i] = leaf
        i += self.half
        self.chars[i], self.tokens[i] = sum(leaf[0]), sum(leaf[1])
        i //= 2
        while i:
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]
            i //= 2


@cache
def _counter(path: str) -> Counter:
    return Counter(path)


EDITS = "array<struct<seq:long,start:long,stop:long,replacement:string>>"


def build_trees(docs: DataFrame, ranks: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text, chars, tokens)``: each document's leaves, to be kept and edited later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [*_counter(ranks).leaves(batch.column(1))]
            arrays = [pa.array([r[k].astype(np.int32) for r in rows], pa.list_(pa.int32())) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], ["doc_id", "text", "chars", "tokens"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return slim.mapInArrow(run, "doc_id long, text string, chars array<int>, tokens array<int>")


def gather_edits(edits: DataFrame) -> DataFrame:
    """``(doc_id, edits)`` of rows (doc_id, seq, start, stop, replacement)."""
    rows = edits.where("doc_id IS NOT NULL").groupBy("doc_id")
    return rows.agg(F.sort_array(F.collect_list(F.struct(*[F.col(c).cast(t) for c, t in (("seq", "long"), ("start", "long"), ("stop", "long"), ("replacement", "string"))]))).cast(EDITS).alias("edits"))


def _apply(tree: Tree, edits, counter: Counter) -> tuple[int, int]:
    n = again = 0
    for e in edits or ():
        if e is not None and e["start"] is not None and e["stop"] is not None:
            again += tree.edit(e["start"], e["stop"], e["replacement"] or "", counter)
            n += 1
    return n, again


def edit_trees(trees: DataFrame, edits: DataFrame, ranks: str) -> DataFrame:
    """The trees after their edits, in the form of build_trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, chars, tokens, es in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tree = Tree(text, chars, tokens)
                _apply(tree, es, _counter(ranks))
                out.append((doc, tree.text, *tree.pairs()))
            cols = [*zip(*out, strict=True)] or [(), (), (), ()]
            kinds = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "text", "chars", "tokens"])

    rows = trees.join(gather_edits(edits), "doc_id", "left").select("doc_id", "text", "chars", "tokens", "edits")
    return rows.mapInArrow(run, "doc_id long, text string, chars array<int>, tokens array<int>")


def edited_counts(rows: DataFrame, ranks: str) -> DataFrame:
    """Counts before and after the edits of rows (doc_id, text, edits), trees being built and edited in one pass.

    ``(doc_id, n_tokens, n_edits, n_tokens_edited, n_pretokens, n_reencoded)``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(ranks)
        for batch in batches:
            out = []
            for text, es, (chars, tokens) in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), counter.leaves(batch.column(1)), strict=True):
                tree = Tree(text or "", chars.tolist(), tokens.tolist())
                before = tree.total
                n, again = _apply(tree, es, counter)
                out.append((before, n, tree.total, len(chars), again))
            cols = [*zip(*out, strict=True)] or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], NAMES)

    slim = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("edits").cast(EDITS).alias("edits"))
    return slim.mapInArrow(run, ", ".join(f"{n} long" for n in NAMES))


NAMES = ["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_pretokens", "n_reencoded"]


def sample_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, text, edits): a deletion, an insertion and a replacement at places that the id decides."""
    at = "pmod(xxhash64(doc_id, {}), length(coalesce(text, '')) + 1)"
    one, two, three = (at.format(i) for i in (1, 2, 3))
    edit = "named_struct('seq', {}L, 'start', {}, 'stop', {}, 'replacement', {})"
    edits = [edit.format(1, one, f"{one} + pmod(xxhash64(doc_id, 4), 40)", "''"), edit.format(2, two, two, "concat(' ', lang, '-', source, ' ', doc_id, chr(10))"), edit.format(3, three, f"{three} + 5", "substring(text, 11, 17)")]
    return docs.selectExpr("doc_id", "text", f"CAST(array({', '.join(edits)}) AS {EDITS}) AS edits")
