"""Language identification by a bit-sliced Bloom filter of n-grams.

Training counts the n-grams of all words for each language in one shuffle. An
n-gram is held by every language where its rate is at least ``FLOOR`` and
``RATIO`` of its highest rate. The filter is one table of ``SLOTS`` language masks: an
n-gram sets its languages' bits in ``HASHES`` slots, so the AND of these slots returns
all languages that hold it, whatever their number. ``FLOOR`` bounds an n-gram set to
``1 / FLOOR`` by its meaning as a share of all occurrences, so the filter's size does not
grow with the corpus. A text is scored whole: its n-grams' masks are counted by language,
and the counts are corrected for the language's rate of false positives, which
follows from how many of its bits are set. The highest corrected count decides.

Words are runs of letters and marks, in lower case, with a boundary at both ends.

Defined results: a null text, an empty one and one without a letter are ``und`` with score 0; a text
with letters of which no n-gram is known gets the language that is commonest in
training, with score 0; ties go to the commoner language, then to the smaller name; ``und`` for
all if nothing can be learned. Rows of a null id are not learned from and not
held out. Repeated rows count each time. Other columns are kept by ``identify``; one named like its
results is replaced.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.wordvec import buffers, chunks, mix, span_hashes, word_spans

ORDERS = (2, 3, 4)
FLOOR = 1e-5  # of a language's n-grams: 100,000 different ones at most
RATIO = 0.5
SLOTS = 1 << 20  # one mask of 64 languages each: 8 MB
HASHES = 4
MAX_LANGUAGES = 4096
_EDGE = np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


@cache
def _alphabet() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: not part of a word, a letter, its lower case."""
    letter, mark = np.zeros(0x110000, dtype=bool), np.zeros(0x110000, dtype=bool)
    lower = np.arange(0x110000, dtype=np.uint64)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            letter[i] = True
            low = c.lower()
            if len(low) == 1:
                lower[i] = ord(low)
        elif i >= 0x300 and unicodedata.category(c)[0] == "M":
            mark[i] = True
    return ~(letter | mark), letter, lower


def _grams(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the words, and n + 1 offsets; words: code points, one after the other."""
    sizes = np.diff(offsets)
    n = len(sizes)
    padded = np.full(len(words) + 2 * n, _EDGE, dtype=np.uint64)
    start = offsets[:-1] + 2 * np.arange(n)
    padded[np.arange(len(words)) + np.repeat(start + 1 - offsets[:-1], sizes)] = words
    counts = [np.maximum(sizes + 3 - k, 0) for k in ORDERS]
    out = np.cumsum([0, *np.sum(counts, axis=0)]).astype(np.int64)
    hashes = np.zeros(out[-1], dtype=np.uint64)
    place = out[:-1].copy()
    for k, count in zip(ORDERS, counts, strict=True):
        rank = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = np.repeat(start, count) + rank
        h = np.full(len(at), k, dtype=np.uint64)
        for j in range(k):
            h = (h ^ padded[at + j]) * _STEP
        hashes[np.repeat(place, count) + rank] = mix(h)
        place += count
    return hashes, out


def _words(texts: pa.Array) -> Iterator[tuple]:
    """For runs of documents: (first, n + 1 word offsets, each word's distinct one, n-grams and offsets of the distinct words, whether a document has a letter)."""
    data, off = buffers(texts)
    blank, letter, lower = _alphabet()
    for i, j in chunks(off):
        part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        codes = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        ends = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))[o]
        letters = np.concatenate(([0], np.cumsum(letter[codes])))[ends]
        if not len(codes):
            yield i, np.zeros(j - i + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(j - i, dtype=bool)
            continue
        starts, last, word_off = word_spans(codes, ends, blank)
        low = lower[codes]
        _, first, same = np.unique(span_hashes(low + _EDGE, starts, last), return_index=True, return_inverse=True)
        sizes = (last - starts + 1)[first]
        offsets = np.cumsum([0, *sizes]).astype(np.int64)
        inside = np.arange(offsets[-1]) - np.repeat(offsets[:-1], sizes)
        grams, gram_off = _grams(low[np.repeat(starts[first], sizes) + inside] + _EDGE, offsets)
        yield i, word_off, same, grams, gram_off, np.diff(letters) > 0


# --- training -------------------------------------------------------------------------


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n), summed up inside the task as far as half a million entries."""
    sums: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    held = 0

    def merged() -> Iterator[pa.RecordBatch]:
        for lang, parts in sums.items():
            grams, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(where, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(grams)), "gram": pa.array(grams.view(np.int64)), "n": pa.array(n)})

    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        for i, word_off, same, grams, gram_off, has in _words(batch.column(1)):
            own = langs[i : i + len(has)]
            of = np.repeat(np.arange(len(has)), np.diff(word_off))
            for lang in set(own):
                times = np.bincount(same[(own == lang)[of]], minlength=len(gram_off) - 1)
                weights = np.repeat(times, np.diff(gram_off))
                found, where = np.unique(grams[weights > 0], return_inverse=True)
                sums.setdefault(lang, []).append((found, np.bincount(where, weights=weights[weights > 0])))
                held += len(found)
        if held > 500_000:
            yield from merged()
            sums, held = {}, 0
    yield from merged()


@dataclass(frozen=True)
class Model:
    languages: list[str]  # commonest first
    table: np.ndarray  # [languages / 64, SLOTS] of masks
    wrong: np.ndarray  # rate of false positives by language


def fit(docs: DataFrame, learned: Column | None = None, text: str = "text", lang: str = "lang") -> Model:
    """The filter of all rows with a language where ``learned`` holds."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.lit(True) if learned is None else learned))
    counts = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    from palimpsest.llm.scratch import Scratch

    scratch = Scratch(docs.sparkSession, "language-id")
    counts = scratch.save(counts, "counts")
    totals = sorted(((r.total, r.lang) for r in counts.groupBy("lang").agg(F.sum("n").alias("total")).limit(MAX_LANGUAGES + 1).collect()), key=lambda x: (-x[0], x[1]))
    if len(totals) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: the column does not hold languages")
    languages = [x for _, x in totals]
    depth = max(1, -(-len(languages) // 64))
    table = np.zeros((depth, SLOTS), dtype=np.uint64)
    if languages:
        known = docs.sparkSession.createDataFrame([(x, i, float(t)) for i, (t, x) in enumerate(totals)], "lang string, i int, total double")
        rates = counts.join(F.broadcast(known), "lang").select("gram", F.struct((F.col("n") / F.col("total")).alias("rate"), F.col("i").alias("i")).alias("own"))
        held = rates.groupBy("gram").agg(F.collect_list("own").alias("own"))  # as many entries as languages
        held = held.select("gram", F.expr(f"filter(own, x -> x.rate >= {FLOOR}D and x.rate >= {RATIO}D * array_max(own).rate)").alias("own"))
        bits = held.select("gram", F.explode("own.i").alias("i"))
        slot = f"((gram & {SLOTS - 1}L) + j * (shiftrightunsigned(gram, 32) | 1L)) & {SLOTS - 1}L"
        bits = bits.select(F.expr("i div 64").alias("word"), F.expr("shiftleft(1L, i % 64)").alias("bit"), F.explode(F.expr(f"transform(sequence(0, {HASHES - 1}), j -> {slot})")).alias("slot"))
        masks = bits.groupBy("word", "slot").agg(F.bit_or("bit").alias("mask")).toArrow()  # SLOTS rows for each 64 languages at most
        table[masks["word"].to_numpy(), masks["slot"].to_numpy()] = masks["mask"].to_numpy().view(np.uint64)
    scratch.drop("counts")
    full = np.array([np.count_nonzero(table[i // 64] >> np.uint64(i % 64) & np.uint64(1)) for i in range(len(languages))])
    return Model(languages, table, (full / SLOTS) ** HASHES)


# --- scoring --------------------------------------------------------------------------


def masks(table: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """[languages / 64, n-grams]: the languages that hold each n-gram."""
    step = (grams >> np.uint64(32)) | np.uint64(1)
    out = np.full((len(table), len(grams)), ~np.uint64(0), dtype=np.uint64)
    for j in range(HASHES):
        out &= table[:, (grams + np.uint64(j) * step) & np.uint64(SLOTS - 1)]
    return out


def counts(texts: pa.Array, table: np.ndarray, languages: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of documents: (n-grams, [documents, languages] n-grams that the language holds, whether there is a letter)."""
    for _, word_off, same, grams, gram_off, has in _words(texts):
        found = masks(table, grams)
        per_word = np.diff(gram_off)
        total = np.concatenate(([0], np.cumsum(per_word[same])))[word_off]
        hits = np.zeros((len(has), languages), dtype=np.int64)
        for i in range(languages):
            bit = (found[i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(np.int64)
            own = np.diff(np.concatenate(([0], np.cumsum(bit)))[gram_off])
            hits[:, i] = np.diff(np.concatenate(([0], np.cumsum(own[same])))[word_off])
        yield np.diff(total), hits, has


def decide(model: Model, total: np.ndarray, hits: np.ndarray, has: np.ndarray) -> tuple[list[str], np.ndarray]:
    if not model.languages:
        return ["und"] * len(total), np.zeros(len(total))
    right = np.maximum((hits - total[:, None] * model.wrong) / (1 - np.minimum(model.wrong, 0.999)), 0)
    best, every = right.argmax(axis=1), right.sum(axis=1)
    score = np.where(has & (every > 0), right.max(axis=1) / np.maximum(every, 1e-9), 0.0)
    return [model.languages[b] if h else "und" for b, h in zip(best, has, strict=True)], score


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns, ``lang_pred`` and ``score`` (the language's share of the corrected counts)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 8 MB for each 64 languages

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            langs: list[str] = []
            scores: list[np.ndarray] = []
            for total, hits, has in counts(texts, sent.value.table, len(sent.value.languages)):
                more, score = decide(sent.value, total, hits, has)
                langs += more
                scores.append(score)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate([*scores, np.zeros(0)]), pa.float64())], ["lang_pred", "score"])

    predict.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    found = F.arrow_udf(predict, "struct<lang_pred: string, score: double>")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    return docs.select(*kept, found(F.col(text)).alias("_found")).select(*kept, F.col("_found.lang_pred").alias("lang_pred"), F.col("_found.score").alias("score"))


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def digest(docs: DataFrame) -> DataFrame:
    """Fit on the rows that are not held out, a prediction for all."""
    out = F.coalesce(is_held_out(F.col("doc_id")), F.lit(False))
    model = fit(docs, ~is_held_out(F.col("doc_id")))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score")
