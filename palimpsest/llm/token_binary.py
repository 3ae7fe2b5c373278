"""Token ids in Simple-8b files: word-aligned codes with per-block offsets.

A 64-bit word holds a selector in its top four bits and 60 bits of ids; the
selector says how many ids of how many bits. Selector 0 is an escape: the next
word is one raw 64-bit id. Every ``BLOCK`` ids begin a new word, and a file's
header has the word offset of each block, so blocks decode independently and
all at once. Encoding finds the best selector of every position by array
arithmetic and walks all blocks in step.

File (little-endian): ``PS8B``, u32 version, u64 documents, u64 ids, u64 blocks,
i64 document ids, u64 ids per document, u64 block offsets (blocks + 1), u64 words.

Texts are sorted by id over range partitions; each task writes files of about
``FILE_IDS`` ids in the shared folder under a temporary name and renames them, so
a repeated task replaces its own files. The manifest names the complete ones.

Defined results: a null or empty text has the end id alone; repeated rows and
equal ids are kept side by side (in order of their text); a null id sorts first
and is written as the smallest 64-bit number; extra columns are ignored; an
empty table gives no files and no rows.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import batched, chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from palimpsest.llm.pretok import PieceTable, in_order, pieces
from palimpsest.llm.scratch import Scratch

MAGIC, VERSION, BLOCK, FILE_IDS, JOINED = b"PS8B", 1, 1024, 1 << 23, 500
#: Fixed values of the code: ids and bits of selectors 1 to 15.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
NULL_ID = -(1 << 63)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, word offset of each block and of the end) of unsigned ids."""
    ids = np.asarray(ids, dtype=np.uint64)
    blocks = -(-len(ids) // BLOCK)
    grid = np.zeros((blocks, BLOCK), dtype=np.uint64)
    grid.reshape(-1)[: len(ids)] = ids
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint64)
    need = np.zeros(grid.shape, dtype=np.uint8)
    for b in np.unique(BITS[1:]):
        need += grid >= np.uint64(1 << int(b))
    column = np.arange(BLOCK, dtype=np.int16)
    select = np.zeros(grid.shape, dtype=np.uint8)
    rank = np.searchsorted(np.unique(BITS[1:]), BITS[1:])
    for s in range(15, 0, -1):  # from one id in a word to 120
        fits, size = need <= rank[s - 1], COUNTS[s]
        # a row has such a word only at two fitting ids half its length apart, or at the end
        some = fits[:, :: max(size // 2, 1)]
        rows = np.flatnonzero((some[:, 1:] & some[:, :-1]).any(axis=1) | fits[:, -1]) if size > 1 else np.arange(blocks)
        over = np.where(fits[rows], np.int16(30_000), column)
        stop = np.minimum.accumulate(over[:, ::-1], axis=1)[:, ::-1]
        select[rows] = np.where((stop - column) >= size, np.uint8(s), select[rows])
    at, row = np.zeros(blocks, dtype=np.int64), np.arange(blocks)
    heads = np.zeros(grid.shape, dtype=bool)
    ends = np.full(blocks, BLOCK)
    ends[-1] = len(ids) - (blocks - 1) * BLOCK
    while len(row):
        heads[row, at] = True
        at = at + COUNTS[select[row, at]]
        more = at < ends[row]
        row, at = row[more], at[more]
    block, first = np.nonzero(heads)
    kind = select[block, first]
    width = 1 + (kind == 0)
    where = np.cumsum(width) - width
    words = np.zeros(int(width.sum()), dtype=np.uint64)
    wide = np.zeros((blocks, BLOCK + 120), dtype=np.uint64)
    wide[:, :BLOCK] = grid
    wide, place = wide.reshape(-1), block * (BLOCK + 120) + first
    for s in range(16):
        pick = np.flatnonzero(kind == s)
        if s == 0:
            words[where[pick] + 1] = wide[place[pick]]
            continue
        word, begin = np.full(len(pick), s << 60, dtype=np.uint64), place[pick]
        for j in range(COUNTS[s] if BITS[s] and len(pick) else 0):
            word |= wide[begin + j] << np.uint64(j * BITS[s])
        words[where[pick]] = word
    offsets = np.zeros(blocks + 1, dtype=np.uint64)
    offsets[1:] = np.cumsum(np.bincount(block, weights=width, minlength=blocks)).astype(np.uint64)
    return words, offsets


def unpack(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n ids again."""
    kind = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words) + 1, dtype=bool)
    for i in np.flatnonzero(kind == 0).tolist():
        if not raw[i]:
            raw[i + 1] = True
    raw = raw[:-1]
    heads = np.flatnonzero(~raw)
    size = COUNTS[kind[heads]]
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype=np.uint64)
    for s in range(16):
        pick = np.flatnonzero(kind[heads] == s)
        if s == 0:
            out[start[pick]] = words[heads[pick] + 1]
        elif BITS[s] and len(pick):
            mask, begin, word = np.uint64((1 << int(BITS[s])) - 1), start[pick], words[heads[pick]]
            for j in range(COUNTS[s]):
                out[begin + j] = (word >> np.uint64(j * BITS[s])) & mask
    # padding at the end of the blocks goes
    block = np.searchsorted(offsets[1:], heads, side="right")
    opens = np.searchsorted(block, np.arange(len(offsets) - 1))
    total = np.append(start, len(out))
    begins = total[opens]
    inside = np.arange(len(out)) - np.repeat(begins, np.diff(np.append(begins, len(out))))
    out = out[inside < BLOCK]
    return out[:n]


def write_file(docs: np.ndarray, counts: np.ndarray, packed: list[tuple[np.ndarray, np.ndarray]]) -> bytes:
    """A file of runs packed one after the other (all but the last of whole blocks)."""
    offsets, base = [np.zeros(1, np.uint64)], 0
    for words, off in packed:
        offsets.append(off[1:] + np.uint64(base))
        base += len(words)
    off = np.concatenate(offsets)
    head = MAGIC + struct.pack("<IQQQ", VERSION, len(docs), int(counts.sum()), len(off) - 1)
    return b"".join([head, docs.astype("<i8").tobytes(), counts.astype("<u8").tobytes(), off.astype("<u8").tobytes(), *(w.astype("<u8").tobytes() for w, _ in packed)])


def read_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, ids per document, all ids)."""
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    version, docs, n, blocks = struct.unpack_from("<IQQQ", data, 4)
    if version != VERSION:
        raise ValueError(f"version {version} of the token file")
    at = 4 + struct.calcsize("<IQQQ")
    a, b, c = at + 8 * docs, at + 16 * docs, at + 16 * docs + 8 * (blocks + 1)
    words = np.frombuffer(data, "<u8", offset=c)
    return np.frombuffer(data, "<i8", docs, at), np.frombuffer(data, "<u8", docs, a).astype(np.int64), unpack(words, np.frombuffer(data, "<u8", blocks + 1, b), n)


def _place(folder: str):
    """(pyarrow file system, path) of a folder."""
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return (fs.LocalFileSystem(), folder) if folder.startswith("/") else fs.FileSystem.from_uri(folder)


@cache
def _tokenizer(path: str):
    """(the library's tokenizer, a table of encoded pieces, the strings that it treats as special tokens)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    vocabulary = tok.get_vocab(with_added_tokens=True)
    nbytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
    nbytes[[*vocabulary.values()]] = [*map(len, vocabulary)]  # a byte is one character of a byte-level entry

    def flat_ids(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.array([*map(len, each)], np.int64)
        return np.fromiter(chain.from_iterable(each), np.uint32, int(size.sum())), size

    def encode(words: list[str]):
        # a space and letters: the pattern parts them again where they were joined
        plain = [i for i, w in enumerate(words) if w[0] == " " and w[1:].isalpha()]
        ends = np.cumsum([len(words[i].encode()) for i in plain])
        ids, _ = flat_ids(["".join(words[i] for i in some) for some in batched(plain, JOINED)])
        total = np.cumsum(nbytes[ids])
        last = np.searchsorted(total, ends)
        if len(plain) and (last[-1] != len(total) - 1 or (total[last] != ends).any()):  # not a byte-level vocabulary
            plain, ids, last = [], ids[:0], last[:0]
        other = sorted({*range(len(words))}.difference(plain))
        more, size = flat_ids([words[i] for i in other])
        return [in_order(plain + other, np.concatenate([ids, more]), np.concatenate([np.diff(last, prepend=-1), size]))]

    return tok, PieceTable(encode), [t.content for t in tok.get_added_tokens_decoder().values()]


def token_ids(texts: pa.Array, tokenizer: str) -> Iterator[np.ndarray]:
    """The library's ids of each whole text; a distinct pre-token is encoded once, a text with a special token's string as a whole."""
    tok, table, special = _tokenizer(tokenizer)
    for _, text, starts, hashes, off in pieces(texts):
        flat, size = table.values(0, table(text, starts, hashes))
        cut = np.concatenate([[0], np.cumsum(size)])[off].tolist()
        edge = np.append(starts, len(text))[off]
        marked = {int(np.searchsorted(edge, m.start(), side="right")) - 1 for s in special for m in re.finditer(re.escape(s), text)}
        for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            yield np.array(tok.encode(text[edge[k] : edge[k + 1]], add_special_tokens=False).ids, np.uint32) if k in marked else flat[a:b]


def _writer(tokenizer: str, folder: str, end: int, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _place(folder)
        part, attempt, seq = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0
        docs, counts, packed, rest, held, total = [], [], [], [], 0, 0

        def flush(last: bool) -> None:
            nonlocal rest, held
            ids = np.concatenate(rest) if rest else np.zeros(0, np.uint32)
            cut = len(ids) if last else len(ids) // BLOCK * BLOCK
            if cut:
                packed.append(pack(ids[:cut]))
            rest, held = [ids[cut:]], len(ids) - cut

        def close() -> pa.RecordBatch:
            nonlocal docs, counts, packed, rest, held, total, seq
            flush(True)
            name = f"part-{part:06d}-{seq:06d}.s8b"
            fs.create_dir(top, recursive=True)
            with fs.open_output_stream(f"{top}/.{name}.{attempt}") as f:
                f.write(write_file(np.array(docs, np.int64), np.array(counts, np.int64), packed))
            try:
                fs.move(f"{top}/.{name}.{attempt}", f"{top}/{name}")
            except OSError:  # some file systems don't replace: an earlier attempt of this task wrote the same
                if not fs.get_file_info(f"{top}/{name}").is_file:
                    raise
                fs.delete_file(f"{top}/.{name}.{attempt}")
            row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(docs)], pa.int64()), pa.array([total], pa.int64())], ["file", "n_docs", "n_ids"])
            docs, counts, packed, rest, held, total, seq = [], [], [], [], 0, 0, seq + 1
            return row

        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            for doc, ids in zip(ids_of, token_ids(batch.column(1), tokenizer), strict=True):
                docs.append(NULL_ID if doc is None else doc)
                counts.append(len(ids) + 1)
                rest += [ids, np.array([end], np.uint32)]
                held += len(ids) + 1
                total += len(ids) + 1
                if held >= 1 << 20:
                    flush(False)
                if total >= file_ids:
                    yield close()
        if docs:
            yield close()

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int = 0, file_ids: int = FILE_IDS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the files; the manifest ``(file, n_docs, n_ids)`` in the order of the ids is lazy: save it before reading."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = slim.repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id", "text")
    return rows.mapInArrow(_writer(tokenizer, folder, end, file_ids), "file string, n_docs long, n_ids long")


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _place(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{top}/{name}") as f:
                    docs, counts, ids = read_file(f.read())
                ends = np.cumsum(counts)
                ids = ids.astype("<u4")
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, mask=docs == NULL_ID), pa.array(start + ends - counts), pa.array(counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_digests(manifest: DataFrame, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` from the files of a saved manifest (a row a file)."""
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    placed = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    width = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(width, "file").mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes all texts' ids in the shared folder and returns what the files hold."""
    scratch = Scratch(docs.sparkSession, "token-files")
    folder = scratch.path("files")
    manifest = scratch.save(write_tokens(docs, folder, tokenizer, **options), "manifest")
    return read_digests(manifest, folder)
