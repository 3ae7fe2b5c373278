"""Language-model scores from a probabilistic suffix tree over words.

Symbols are words (A-Z lowered) and one end for each text. The root's
distribution discounts each word's training count and gives the freed mass to
one unknown symbol. A context of up to ``DEPTH`` words that occurred ``MIN`` times,
whatever the size of the corpus, becomes a state by a divergence test: with
every occurrence left out in turn, its discounted distribution must predict the
next symbols better than the next shorter state does, by ``PENALTY`` times the
logarithm of its occurrences. A state discounts the counts of all next symbols
that it saw and hands the freed mass to the shorter state, so each state's
distribution sums to one. A text is scored word by word from the longest state.

The model is never on one machine, and the text is never shuffled. The rows of
an input split are cut into pieces of about ``PIECE`` bytes of text. Level by
level a piece sends its distinct keys (context and next symbol) in packed runs,
one for each bucket, and gets back the total of each key and the verdict on each
context in the same order, so an answer takes one or two bytes a key. Contexts
go as the numbers of their words. Buckets are dealt by context, of two words by
the last one (if that occurred more than ``HOT`` times, by the word before too);
a context that occurred more than ``HOT`` times is spread over several by its
next symbols, and its test is summed up from them. A key has
one entry for each piece at most, so a word that is a third of all tokens stays
light. Buckets are many, of a bounded share of the corpus each, and a task takes
its buckets one after the other.

Defined results: a null or wordless text has one token, its end; repeated rows
are counted and scored one by one; a null id counts as the empty string for the
fold; extra columns are ignored; an empty table gives none; without training
rows every token has the base model's probability of an unknown one.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.scratch import Scratch
from palimpsest.llm.token_binary import _place
from palimpsest.llm.wordvec import buffers, mix, release, words

MIN, DISCOUNT, PENALTY, DEPTH = 16, 0.75, 1.0, 2
PIECE, BUCKET, HOT = 14 << 20, 4 << 20, 1 << 18
LOGS = 1024  # probabilities travel as whole numbers of 1/LOGS bits
END = mix(np.array([1], np.uint64))[0]
_LEFT, _HALF = np.uint64(0x9E3779B97F4A7C15), np.uint64(32)


def join_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A key of two keys in order."""
    return mix(a * _LEFT + mix(b + np.uint64(7)))


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct key, in ascending order of keys; the number of each key's distinct one)."""
    order = np.argsort(key)
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    back = np.empty(len(key), np.int32)
    back[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return order[new], back


def ordered(bucket: np.ndarray, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The order by bucket, context and symbol; one sort of one number where the three fit into it."""
    wide = [int(x.max(initial=0)).bit_length() for x in (bucket, context, symbol)]
    if sum(wide) > 64:
        context = distinct(context)[1].astype(np.uint64)
        wide[1] = int(context.max(initial=0)).bit_length()
    if sum(wide) > 64:
        return np.lexsort((symbol, context, bucket))
    return np.argsort((bucket.astype(np.uint64) << np.uint64(wide[1]) | context) << np.uint64(wide[2]) | symbol)


def heads(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return np.flatnonzero(new)


def shifted(x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    out[1:] = x[:-1]
    return out


def pairs(older: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Contexts of two words by their numbers, the last word's above; they ascend in small steps. Numbers that don't fit are hashed."""
    return np.where((older | last) >> _HALF == 0, last << _HALF | older, join_keys(older, last))


def parts(of: np.ndarray) -> np.ndarray:
    """The buckets over which so many occurrences are spread."""
    return np.maximum(-(-of // HOT), 1).astype(np.uint64)


# --- packed runs ---------------------------------------------------------------------

def packed(*columns: np.ndarray) -> bytes:
    """Arrays of whole or floating numbers as one compressed string; bytes of one rank lie together, so small numbers take few."""
    size = np.array([len(columns), *(x.nbytes for x in columns)], "<u4").tobytes()
    planes = (np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T).tobytes() for x in columns)
    data = b"".join([size, *planes])
    return len(data).to_bytes(4, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpacked(blob: bytes, *kinds: str) -> list[np.ndarray]:
    data = pa.decompress(blob[4:], int.from_bytes(blob[:4], "little"), codec="zstd", asbytes=True)
    size = np.frombuffer(data, "<u4", 1 + len(kinds))[1:].tolist()
    out, at = [], 4 * (1 + len(kinds))
    for kind, n in zip(kinds, size, strict=True):
        wide = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, n, at).reshape(wide, -1).T).view(kind).reshape(-1))
        at += n
    return out


def steps(x: np.ndarray, heads: np.ndarray | slice = slice(0, 1)) -> np.ndarray:
    """Differences, from the value itself at each head."""
    out = x.copy()
    out[1:] -= x[:-1]
    out[heads] = x[heads]
    return out


def unstepped(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The values again of runs of the given sizes."""
    total, head = np.cumsum(x, dtype=x.dtype), np.cumsum(size) - size
    return total - np.repeat(total[head] - x[head], size)


#: Contexts, occurrences of those in several buckets, numbers of symbols; symbols (at first their keys, then their numbers), counts, probabilities.
SENT = ("<u8", "<u8", "<u4", "<u8", "<u4", "<u2")


def sent(context: np.ndarray, of: np.ndarray, size: np.ndarray, symbol: np.ndarray, n: np.ndarray, logs: np.ndarray) -> bytes:
    """The columns of SENT; contexts ascend, and so do the symbols of each, so their differences are sent. Probabilities lie by symbol, where equal ones meet."""
    by = np.argsort(symbol, kind="stable")
    return packed(steps(context), of, size, steps(symbol, np.cumsum(size, dtype=np.int64) - size), n, steps(logs[by]))


def received(blob: bytes) -> list[np.ndarray]:
    context, of, size, symbol, n, logs = unpacked(blob, *SENT)
    symbol, out = unstepped(symbol, size.astype(np.int64)), np.empty_like(logs)
    out[np.argsort(symbol, kind="stable")] = np.cumsum(logs, dtype=logs.dtype)
    return [np.cumsum(context, dtype=context.dtype), of, size, symbol, n, out]


#: Totals, numbers of next symbols of the contexts that are states, and at first the places of the words in their bucket.
ANSWER = ("<u8", "<u4", "<u8")


class Level:
    """A piece's distinct keys of one level, in the order in which they are sent: by bucket, context, symbol."""

    def __init__(self, key: np.ndarray, learn: np.ndarray, buckets: int, context: np.ndarray | None = None, of: np.ndarray | None = None, p: np.ndarray | None = None, symbol: np.ndarray | None = None, dealt: np.ndarray | None = None):
        """Words alone are the first level; then keys have a context, its occurrences, the symbol's number, its probability so far, and what the context is dealt by."""
        first, back = distinct(key)
        n = np.bincount(back[learn], minlength=len(first)).astype(np.uint32)
        context, of, spread = (np.zeros(len(first), np.uint64), np.zeros(len(first), np.int64), mix(key[first])) if context is None else (context[first], of[first], mix((context if dealt is None else dealt)[first]))
        if symbol is not None:
            spread = mix(spread + mix(symbol[first]) % parts(of))
        bucket = ((spread >> np.uint64(20)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
        order = np.argsort(bucket, kind="stable") if symbol is None else ordered(bucket, context, symbol[first])
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.back, self.buckets = place[back], np.uint64(buckets)
        self.symbol, self.n, self.bucket, self.context, self.of = (key if symbol is None else symbol)[first][order], n[order], bucket[order], context[order], of[order]
        self.logs = np.zeros(len(order), np.uint16) if p is None else np.minimum(np.round(-LOGS * np.log2(p[first][order])), 65535).astype(np.uint16)
        self.cuts = heads(self.bucket)
        edge = np.zeros(len(order), bool)
        edge[heads(self.context)] = True
        edge[self.cuts] = True
        self.runs = np.flatnonzero(edge)

    def blobs(self) -> Iterator[tuple[int, bytes]]:
        size = np.diff(np.append(self.runs, len(self.n)))
        at = np.searchsorted(self.runs, np.append(self.cuts, len(self.n)))
        for k, (a, b) in enumerate(zip(self.cuts, np.append(self.cuts, len(self.n))[1:], strict=True)):
            r = self.runs[at[k] : at[k + 1]]
            yield int(self.bucket[a]), sent(self.context[r], np.where(self.of[r] > HOT, self.of[r], 0).astype("<u8"), size[at[k] : at[k + 1]].astype("<u4"), self.symbol[a:b], self.n[a:b], self.logs[a:b])

    def answers(self, folder: str, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(total, kept share of the context, number) of each key as sent; a context that is no state keeps 0."""
        if not len(self.n):
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64)
        t = read_answers(folder, piece)
        each = [unpacked(x, *ANSWER) for x in t.column("blob").to_pylist() if x is not None]
        total, kinds, number = (np.concatenate(x) for x in zip(*each, strict=True))
        if len(number):  # a common word has a small number
            number = number * self.buckets + self.bucket
        if len(total) != len(self.n) or len(kinds) != len(self.runs):
            raise RuntimeError("the rows of a split came in another order than before")
        keep = DISCOUNT * kinds / np.maximum(self.of[self.runs], 1)
        hot = t.filter(t.column("context").is_valid())
        if len(hot):
            names = hot.column("context").to_numpy().astype(np.uint64)
            order = np.argsort(names)
            run = self.context[self.runs]
            at = order[np.minimum(np.searchsorted(names[order], run), len(order) - 1)]
            keep = np.where(names[at] == run, hot.column("keep").to_numpy()[at], keep)
        return total.astype(np.int64), np.repeat(keep.astype(float), np.diff(np.append(self.runs, len(self.n)))), number


# --- pieces ----------------------------------------------------------------------------

def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """(name, rows) of runs of one split's rows of about PIECE bytes of text; the cuts depend on the rows alone."""
    chunk, seq, held, size = None, 0, [], 0

    def name() -> int:
        return int(join_keys(np.array([chunk], np.int64).astype(np.uint64), np.array([seq], np.uint64)).astype(np.int64)[0])

    for batch in batches:
        c = batch.column("chunk").to_numpy()
        nbytes = np.diff(buffers(batch.column("text"))[1])
        a = 0
        while a < len(c):
            if c[a] != chunk:
                if held:
                    yield name(), held
                chunk, seq, held, size = int(c[a]), 0, [], 0
            other = np.flatnonzero(c[a:] != chunk)
            end = a + int(other[0]) if len(other) else len(c)
            b = min(end, a + 1 + int(np.searchsorted(np.cumsum(nbytes[a:end]), PIECE - size)))
            held.append(batch.slice(a, b - a))
            size += int(nbytes[a:b].sum())
            a = b
            if size >= PIECE:
                yield name(), held
                seq, held, size = seq + 1, [], 0
    if held:
        yield name(), held


class Tokens:
    """Words and ends of a piece's texts."""

    def __init__(self, held: list[pa.RecordBatch]):
        key, size = [], []
        for batch in held:
            for _, h, off in words(batch.column("text")):
                key.append(np.insert(h, off[1:], END))
                size.append(np.diff(off) + 1)
        self.key, self.size = np.concatenate(key), np.concatenate(size)
        self.learns = np.concatenate([b.column("learn").to_numpy(zero_copy_only=False) for b in held])
        self.first = np.cumsum(self.size) - self.size
        self.at = (np.arange(len(self.key)) - np.repeat(self.first, self.size)).astype(np.int32)
        self.learn = np.repeat(self.learns, self.size)


class Root:
    """Totals of the training tokens."""

    def __init__(self, total: int, kinds: int, once: int, twice: int):
        self.total, self.kinds = total, kinds
        self.spare = min(max(once / max(once + 2 * twice, 1), 0.05), 0.95)

    def probability(self, n: np.ndarray) -> np.ndarray:
        freed = self.spare * self.kinds
        return np.where(n > 0, n - self.spare, freed) / max(self.total, 1) if self.total else np.ones(len(n))


def walk(t: Tokens, piece: int, folders: list[str], root: Root | None, buckets: int, send: bool) -> tuple[Level | None, np.ndarray, np.ndarray]:
    """(keys of the next level, if they are asked for; each token's training count; its probability by the levels known)."""
    level = Level(t.key, t.learn, buckets)
    if not folders:
        return level, np.zeros(0), np.zeros(0)
    count, _, symbol = level.answers(folders[0], piece)
    count, symbol = count[level.back], symbol[level.back]
    del level
    p, n, state, last = root.probability(count), count, np.ones(len(t.key), bool), shifted(symbol)
    context, dealt = last, None
    for k in range(1, len(folders) + bool(send)):
        of = shifted(n)
        use = np.flatnonzero((t.at >= k) & (of >= MIN) & state)
        level = Level(join_keys(context[use], symbol[use]), t.learn[use], buckets, context[use], of[use], p[use] if k == len(folders) else None, symbol[use], None if dealt is None else dealt[use])
        if k == len(folders):
            return level, count, p
        total, keep, _ = level.answers(folders[k], piece)
        total, keep = total[level.back], keep[level.back]
        del level
        p[use] = np.where(keep > 0, np.maximum(total - DISCOUNT, 0) / of[use] + keep * p[use], p[use])
        n, state = np.zeros_like(n), np.zeros_like(state)
        n[use], state[use] = total, keep > 0
        if k + 1 < len(folders) + bool(send):
            older = shifted(context)  # contexts with the same last word lie together
            context, dealt = pairs(older, last) if k == 1 else join_keys(older, last), mix(last) + mix(older) % parts(shifted(count))
    return None, count, p


def _sent(folders: list[str], root: Root | None, buckets: int):
    """(bucket, piece, blob): the distinct keys of the level after the known ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, held in _pieces(batches):
            out = [*walk(Tokens(held), piece, folders, root, buckets, True)[0].blobs()]
            release()
            for i in range(0, len(out), 500):
                some = out[i : i + 500]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in some], pa.int64()), pa.array([piece] * len(some), pa.int64()), pa.array([x for _, x in some], pa.binary())], ["bucket", "piece", "blob"])

    return run


# --- buckets -----------------------------------------------------------------------------

FOUND = "piece long, bucket long, blob binary, context long, of long, kinds long, once long, more long, gain double"


def kept(of, kinds, once, more, gain):
    """The share that a context hands on as a state, 0 if the divergence test fails.

    of: occurrences; kinds: next symbols; once: those seen once; more: occurrences of the others;
    gain: their sum of n times the logarithm of (n - 1 - DISCOUNT) over the shorter state's probability.
    """
    rest = np.maximum(of - 1, 1)
    left = gain - more * np.log(rest) + once * np.log(DISCOUNT * np.maximum(kinds - 1, 1) / rest)
    return np.where(left > PENALTY * np.log(np.maximum(of, 1)), DISCOUNT * kinds / np.maximum(of, 1), 0.0)


def _kept_sql() -> str:
    rest = "greatest(of - 1, 1)"
    left = f"gain - more * ln({rest}) + once * ln({DISCOUNT} * greatest(kinds - 1, 1) / {rest})"
    return f"CASE WHEN {left} > {PENALTY} * ln(of) THEN {DISCOUNT} * kinds / of ELSE 0D END"


def _merged(level: int, buckets: int, bucket: int, names: list[int], blobs: list[bytes]) -> Iterator[dict]:
    """Rows of FOUND of one bucket: each piece's answer, and sums of what other buckets hold parts of."""
    each = [received(x) for x in blobs]
    key, n = np.concatenate([x[3] for x in each]), np.concatenate([x[4] for x in each])
    if level:
        key = join_keys(np.concatenate([np.repeat(x[0], x[2]) for x in each]), key)
    first, back = distinct(key)
    total = np.bincount(back, weights=n, minlength=len(first)).astype(np.int64)
    split = lambda x, column: np.split(x, np.cumsum([len(e[column]) for e in each])[:-1])
    number = [np.zeros(0, np.uint64)] * len(each)
    if not level:
        yield {"of": int(total.sum()), "kinds": int((total > 0).sum()), "once": int((total == 1).sum()), "more": int((total == 2).sum())}
        states = [np.zeros(len(x[0]), np.uint32) for x in each]
        place = np.empty(len(first), np.uint64)
        place[np.argsort(-total, kind="stable")] = np.arange(len(first), dtype=np.uint64)
        number = split(place[back], 3)
    else:
        run, of = np.concatenate([x[0] for x in each]), np.concatenate([x[1] for x in each])
        size = np.concatenate([x[2] for x in each])
        owner = np.repeat(np.arange(len(run)), size)[first]
        rfirst, rback = distinct(run)
        mine, of = rback[owner], of[rfirst].astype(np.int64)
        of = np.where(of > 0, of, np.bincount(mine, weights=total, minlength=len(of)).astype(np.int64))  # all of its symbols are here
        several = total >= 2
        gains = np.where(several, total * (np.log(np.maximum(total - 1 - DISCOUNT, 1e-9)) + np.concatenate([x[5] for x in each])[first] * (np.log(2) / LOGS)), 0)
        kinds, once, more, gain = (np.bincount(mine, weights=w, minlength=len(of)) for w in (total > 0, total == 1, np.where(several, total, 0), gains))
        hot = of > HOT
        states = split(np.where(~hot & (kept(of, kinds, once, more, gain) > 0), kinds, 0).astype(np.uint32)[rback], 0)
        name = run[rfirst].astype(np.int64)
        for i in np.flatnonzero(hot).tolist():
            yield {"context": int(name[i]), "of": int(of[i]), "kinds": int(kinds[i]), "once": int(once[i]), "more": int(more[i]), "gain": float(gain[i])}
        if hot.any():
            for piece, x in zip(names, split(rback, 0), strict=True):
                for i in np.unique(x[hot[x]]).tolist():
                    yield {"piece": piece, "context": int(name[i])}
    for piece, *columns in zip(names, split(total[back].astype(np.uint64), 3), states, number, strict=True):
        yield {"piece": piece, "bucket": bucket, "blob": packed(*columns)}


def _runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Runs of rows with one value of a column."""
    now, held = None, []
    for batch in batches:
        c = batch.column(column).to_numpy()
        cuts = [*heads(c).tolist(), len(c)] if len(c) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if c[a] != now:
                if held:
                    yield now, held
                now, held = int(c[a]), []
            held.append(batch.slice(a, b - a))
    if held:
        yield now, held


_FOUND_TYPES = pa.schema([(x.split()[0], {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}[x.split()[1]]) for x in FOUND.split(", ")])


def _totals(level: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held in _runs(batches, "bucket"):
            names, blobs = ([x for b in held for x in b.column(c).to_pylist()] for c in ("piece", "blob"))
            out = [*_merged(level, buckets, bucket, names, blobs)]
            for i in range(0, len(out), 500):
                yield pa.RecordBatch.from_pylist(out[i : i + 500], schema=_FOUND_TYPES)

    return run


# --- answers -------------------------------------------------------------------------------

def _answer_file(folder: str, piece: int):
    fs, top = _place(folder)
    return fs, f"{top}/{piece & 0xFFF:03x}", f"{piece & (1 << 64) - 1:016x}"


def _answers(folder: str):
    """Writes each piece's answers as one file under a temporary name and renames it, so a repeated task does no harm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, done = TaskContext.get().taskAttemptId(), 0
        for piece, held in _runs(batches, "piece"):
            fs, place, name = _answer_file(folder, piece)
            fs.create_dir(place, recursive=True)
            with fs.open_output_stream(f"{place}/.{name}.{attempt}") as f, pa.ipc.new_stream(f, held[0].schema) as out:
                for batch in held:
                    out.write_batch(batch)
            try:
                fs.move(f"{place}/.{name}.{attempt}", f"{place}/{name}")
            except OSError:  # some file systems don't replace: an earlier attempt wrote the same
                if not fs.get_file_info(f"{place}/{name}").is_file:
                    raise
                fs.delete_file(f"{place}/.{name}.{attempt}")
            done += 1
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["pieces"])

    return run


def read_answers(folder: str, piece: int) -> pa.Table:
    fs, place, name = _answer_file(folder, piece)
    with fs.open_input_stream(f"{place}/{name}") as f, pa.ipc.open_stream(f) as t:
        return t.read_all()


# --- scores ----------------------------------------------------------------------------------

NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(folders: list[str], root: Root, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, held in _pieces(batches):
            t = Tokens(held)
            _, n, p = walk(t, piece, folders, root, buckets, False)
            release()
            base = np.log10((n + 0.1) / (root.total + 0.1 * (root.kinds + 1)))
            sums = [np.add.reduceat(x, t.first) for x in ((n > 0).astype(np.int64), base, np.log10(p) if root.total else base)]
            ids = pa.concat_arrays([b.column("doc_id") for b in held])
            yield pa.RecordBatch.from_arrays([ids, pa.array(~t.learns), pa.array(t.size, pa.int64()), pa.array(sums[0]), pa.array(np.full(len(ids), root.total, np.int64)), pa.array(sums[1]), pa.array(sums[2])], NAMES)

    return run


@contextmanager
def _tidy(spark) -> Iterator[None]:
    """Meanwhile a job's shuffle files go when it ends; the cleaner alone often leaves a level's until the next one's are written."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _settle(spark) -> None:
    """Lets Spark's cleaner remove the shuffle files that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def score_texts(docs: DataFrame, folds: int = 10, held: int = 0, depth: int = DEPTH, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row."""
    with _tidy(docs.sparkSession):
        return _learned(docs, folds, held, depth, id_col, text)


def _learned(docs: DataFrame, folds: int, held: int, depth: int, id_col: str, text: str) -> DataFrame:
    """Learns the levels one by one; what is returned scores with them."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix-lm")
    cols = [F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")]
    split = F.xxhash64("_metadata.file_path", "_metadata.file_block_start").alias("chunk")
    try:
        rows = docs.select(*cols, split)
        rows.schema  # noqa: B018  analysed now
    except AnalysisException:  # not a plain scan of files: make it one
        rows = scratch.save(docs.select(*cols), "texts").select("doc_id", "text", split)
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds
    rows = rows.select("chunk", "text", "doc_id", (fold != held).alias("learn"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table_bytes = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    buckets = max(2 * width, min(-(-table_bytes // BUCKET), 1 << 24))
    folders, root = [], None
    for level in range(depth + 1):
        sent = rows.mapInArrow(_sent(list(folders), root, buckets), "bucket long, piece long, blob binary")
        found = scratch.save(sent.repartition(width, "bucket").sortWithinPartitions("bucket").mapInArrow(_totals(level, buckets), FOUND), f"found-{level}")
        del sent
        _settle(spark)
        answers = found.where("blob IS NOT NULL").select("piece", "bucket", "blob", F.lit(None).cast("long").alias("context"), F.lit(None).cast("double").alias("keep"))
        if not level:
            sums = found.where("piece IS NULL").agg(*[F.sum(c) for c in ("of", "kinds", "once", "more")]).first()
            if sums[0] is None:
                return spark.createDataFrame([], SCORES)
            root = Root(*sums)
        else:
            hot = found.where("piece IS NULL").groupBy("context").agg(F.max("of").alias("of"), *[F.sum(c).alias(c) for c in ("kinds", "once", "more", "gain")])
            met = found.where("piece IS NOT NULL AND blob IS NULL").select("piece", "context").distinct()
            hot = met.join(hot.select("context", F.expr(_kept_sql()).alias("keep")), "context")
            answers = answers.unionByName(hot.select("piece", F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("blob"), "context", "keep"))
        answers = answers.repartition(width, "piece").sortWithinPartitions("piece", "bucket")
        folders.append(scratch.path(f"level-{level}"))
        answers.mapInArrow(_answers(folders[-1]), "pieces long").agg(F.sum("pieces")).first()
        scratch.drop(f"found-{level}")
        del found, answers
        _settle(spark)
        if not root.total:
            break
    return rows.mapInArrow(_scored(folders, root, buckets), SCORES)
