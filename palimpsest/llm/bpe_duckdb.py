"""Byte-level BPE by recursive DuckDB queries inside each partition.

Distinct pre-tokens become token-position rows; one that is a vocabulary entry
is that token. A recursive query joins each row and its right neighbour with
the merge table into a word's list of ranked pairs, contracts the leftmost pair
of least rank, joins only the two pairs that this makes anew, and goes on with
the words that changed until none does. Decoding is an ordered aggregation of
the tokens' bytes by position.

A piece of more than ``LONG`` bytes would take rows in the square of its
length; such pieces follow the same rule (leftmost pair of least rank) through
a heap, which takes time in n log n.

Defined results: a null or empty text has no tokens; repeated rows give one row
each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import cache
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.pretok import PieceTable, gather, in_order, pieces
from palimpsest.llm.wordvec import release

LONG, SQUARES, HELD, RUNS = 48, 1 << 23, 100_000, 4
#: A pair as one number: its rank (or NONE), the first byte's place in the word (below 64), its left token.
PLACE, RANK, NONE = 1 << 32, 1 << 38, 1 << 24

STEP = f"""
WITH RECURSIVE step(wid, pairs, best) AS (
  SELECT wid, list(pair ORDER BY pair & {RANK - 1}), min(pair)
  FROM (SELECT wid, coalesce(m.rank, {NONE}) * {RANK} + pos * {PLACE} + tok AS pair FROM base LEFT JOIN merges m ON m.a = tok AND m.b = after)
  GROUP BY wid
  UNION ALL
  SELECT wid, pairs, list_min(pairs)
  FROM (SELECT wid, CASE WHEN i > 1 THEN pairs[:(i - 2)] || [coalesce(l.rank, {NONE}) * {RANK} + before, coalesce(r.rank, {NONE}) * {RANK} + place + made] || pairs[(i + 2):]
                         ELSE [coalesce(r.rank, {NONE}) * {RANK} + place + made] || pairs[(i + 2):] END AS pairs
        FROM (SELECT wid, pairs, i, CAST(best // {RANK} AS INTEGER) AS made, best & {RANK - PLACE} AS place, pairs[i - 1] & {RANK - 1} AS before, pairs[i + 2] & {PLACE - 1} AS after
              FROM (SELECT *, list_position(pairs, best) AS i FROM step WHERE best < {NONE * RANK}))
        LEFT JOIN merges l ON l.a = before & {PLACE - 1} AND l.b = made
        LEFT JOIN merges r ON r.a = made AND r.b = after))
SELECT pairs FROM step WHERE best >= {NONE * RANK} ORDER BY wid
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """One partition's DuckDB connection with the merge table and the vocabulary."""

    def __init__(self, path: str):
        import duckdb

        self.ranks = read_ranks(path)
        self.token = {r: t for t, r in self.ranks.items()}
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "200MB"})
        rows = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        a, b, r = (pa.array(x, pa.int32()) for x in zip(*rows, strict=True))
        self._table("merges", pa.table({"a": a, "b": b, "rank": r}))
        self._table("vocabulary", pa.table({"id": pa.array(list(self.token), pa.int32()), "bytes": pa.array(list(self.token.values()), pa.binary())}))
        digits = [b" %d" % i for i in range(max(self.token) + 1)]
        self.digit_size = np.array([*map(len, digits)], np.int64)
        self.digit_start = np.cumsum(self.digit_size) - self.digit_size
        self.digits = np.frombuffer(b"".join(digits), np.uint8)
        self.pieces = PieceTable(self._columns)

    def _table(self, name: str, rows: pa.Table) -> None:
        self.con.register("_in", rows)
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM _in")
        self.con.unregister("_in")

    def encode_pieces(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each word in one array, and how many each has."""
        known = [self.ranks.get(w, -1) for w in words]
        long = [i for i, w in enumerate(words) if known[i] < 0 and len(w) > LONG]
        short = [i for i, w in enumerate(words) if known[i] < 0 and len(w) <= LONG]
        whole = [i for i, x in enumerate(known) if x >= 0]
        flat, size = [np.array([known[i] for i in whole], np.int32)], [np.ones(len(whole), np.int64)]
        for i in long:
            flat.append(self._long(words[i]))
            size.append(np.array([len(flat[-1])]))
        # a word's lists take room in the square of its length
        run = np.cumsum([len(words[i]) ** 2 for i in short]) // SQUARES
        for some in np.split(np.array(short, np.int64), np.flatnonzero(np.diff(run)) + 1) if short else []:
            ids, n = self._contract([words[i] for i in some.tolist()])
            flat.append(ids)
            size.append(n)
        return in_order([*whole, *long, *short], np.concatenate(flat), np.concatenate(size))

    def _contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same of words of at most LONG bytes, by the recursive query."""
        size = np.array([*map(len, words)])
        first = np.cumsum(size) - size
        tok = self.byte[np.frombuffer(b"".join(words), np.uint8)].astype(np.int64)
        after = np.append(tok[1:], -1)
        after[first + size - 1] = -1
        self._table("base", pa.table({"wid": np.repeat(np.arange(len(words)), size), "pos": np.arange(len(tok)) - np.repeat(first, size), "tok": tok, "after": after}))
        pairs = self.con.sql(STEP).to_arrow_table().column(0).combine_chunks()
        ids = pairs.flatten().to_numpy() & (PLACE - 1)
        return ids.astype(np.int32), np.diff(pairs.offsets.to_numpy()).astype(np.int64)

    def _long(self, word: bytes) -> np.ndarray:
        """The same contractions, kept in a heap of (rank, position)."""
        part = [word[i : i + 1] for i in range(len(word))]
        right, left, version = [*range(1, len(part)), -1], [*range(-1, len(part) - 1)], [0] * len(part)
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = right[i] if i >= 0 else -1
            if j >= 0 and (r := self.ranks.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (r, i, version[i], version[j]))

        for i in range(len(part)):
            offer(i)
        gone = [False] * len(part)
        while heap:
            _, i, u, v = heapq.heappop(heap)
            j = right[i]
            if gone[i] or j < 0 or version[i] != u or version[j] != v:
                continue
            part[i] += part[j]
            gone[j], right[i] = True, right[j]
            version[i] += 1
            version[j] += 1
            if right[i] >= 0:
                left[right[i]] = i
            offer(left[i])
            offer(i)
        return np.array([self.ranks[p] for p, x in zip(part, gone, strict=True) if not x], np.int32)

    def decode_lists(self, ids: np.ndarray, size: np.ndarray) -> list[bytes]:
        """The bytes of each list of ids, by ordered aggregation; an unknown id is an error."""
        wid = np.repeat(np.arange(len(size), dtype=np.int32), size)
        self._table("encoded", pa.table({"wid": wid, "pos": np.arange(len(ids), dtype=np.int64), "id": ids.astype(np.int32)}))
        rows = self.con.execute("SELECT wid, string_agg(coalesce(hex(v.bytes), error('unknown token id')), '' ORDER BY pos) AS x FROM encoded LEFT JOIN vocabulary v USING (id) GROUP BY wid").fetchall()
        out = [b""] * len(size)
        for i, x in rows:
            out[i] = bytes.fromhex(x)
        return out

    def _columns(self, words: list[str]):
        """Each distinct piece's ids, and their decimal digits with a space before each."""
        ids, size = self.encode_pieces([w.encode("utf-8", "replace") for w in words])
        wide = self.digit_size[ids]
        digits = gather(self.digits, self.digit_start[ids], wide), np.add.reduceat(wide, np.cumsum(size) - size)
        return [(ids, size), digits]

    def documents(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, bytes]]:
        """Each text's ids, and their decimal digits joined by spaces."""
        for some in batched(pieces(texts), RUNS):
            each = self.pieces.learn([(text, starts, hashes) for _, text, starts, hashes, _ in some])
            for slots, (*_, off) in zip(each, some, strict=True):
                cols = []
                for k in range(2):
                    flat, size = self.pieces.values(k, slots)
                    cut = np.concatenate([[0], np.cumsum(size)])[off].tolist()
                    cols.append([flat[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)])
                for ids, digits in zip(*cols, strict=True):
                    yield ids, digits[1:].tobytes()


@cache
def codec_of(path: str) -> Codec:
    return Codec(path)


def _partition(path: str, make, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codec = codec_of(path)
            yield pa.RecordBatch.from_arrays([batch.column(0), *make(codec, batch.column(1))], ["doc_id", *names])
            del codec
            release()
        codec_of.cache_clear()  # a worker that goes on with other work keeps nothing
        release()

    return run


def _slim(df: DataFrame, id_col: str, column: str, kind: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(column).cast(kind).alias("value"))


def encode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids)`` of every row; ranks is the path of a rank file that all executors have."""

    def make(codec: Codec, texts: pa.Array) -> list[pa.Array]:
        return [pa.array([ids for ids, _ in codec.documents(texts)], pa.list_(pa.int32()))]

    return _slim(docs, id_col, text, "string").mapInArrow(_partition(ranks, make, ["ids"]), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """``(doc_id, bytes)`` of rows (doc_id, ids); null ids decode to no bytes."""

    def make(codec: Codec, lists: pa.Array) -> list[pa.Array]:
        each = [np.asarray(x if x is not None else [], np.int32) for x in lists.to_pylist()]
        out: list[bytes] = []
        for i in range(0, len(each), 200):
            some = each[i : i + 200]
            out += codec.decode_lists(np.concatenate(some), np.array([len(x) for x in some]))
        return [pa.array(out, pa.binary())]

    return _slim(encoded, "doc_id", "ids", "array<int>").mapInArrow(_partition(ranks, make, ["bytes"]), "doc_id long, bytes binary")


def digests(docs: DataFrame, ranks: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every row."""

    def make(codec: Codec, texts: pa.Array) -> list[pa.Array]:
        n, a, b, held = [], [], [], []

        def check() -> None:
            if held:
                b.extend(hashlib.sha256(x).hexdigest() for x in codec.decode_lists(np.concatenate(held), np.array([*map(len, held)])))
                held.clear()

        waiting = 0
        for ids, digits in codec.documents(texts):
            n.append(len(ids))
            a.append(hashlib.sha256(digits).hexdigest())
            held.append(ids)
            waiting += len(ids)
            if waiting > HELD:
                check()
                waiting = 0
        check()
        return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]

    return _slim(docs, id_col, text, "string").mapInArrow(_partition(ranks, make, ["n_tokens", "ids_sha256", "decoded_sha256"]), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
