"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

A document becomes a row of statistics of its whole text (sizes, shares of kinds
of characters, repetition, stop words). Standardised statistics go through
``FEATURES`` random cosines, whose products approximate a Gaussian kernel.
Partitions sum their normal equations; the sums of ``PARTS`` partitions are added
up in one task, and the driver solves them. Scores of a part of the sample that the ridge
did not see are calibrated by isotonic regression, made strictly increasing
between its steps.

The fit takes at most about ``SAMPLE`` labelled rows (a documented bound), chosen
by a hash of the id. Rows of the held-out fold never enter it.

Defined results: a null or empty text is scored like any other, on zero
statistics; repeated rows each get a row; conflicting labels of one id all
count; a null id counts as the empty string for the fold; null labels are
skipped; without labels every score is 0.5; extra columns are ignored; an empty
table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.quality_rules import STOP_WORDS
from palimpsest.llm.wordvec import buffers, release, shingles, words

FEATURES, RIDGE, SAMPLE, PARTS, CLIP = 256, 1e-3, 20_000, 8, 4.0
KINDS = ["A-Z", "a-z", "0-9", " ", "\n", "!", "|", "#*$%&<>", ".", ",", "@/:_", "high"]
_KIND = np.full(256, len(KINDS), dtype=np.int64)
for _i, _k in enumerate(KINDS[:-1]):
    _KIND[[*range(ord(_k[0]), ord(_k[2]) + 1)] if len(_k) == 3 and _k[1] == "-" else [ord(c) for c in _k]] = _i
_KIND[128:] = len(KINDS) - 1
WIDTH = len(KINDS) + 1 + 10
STOPS = np.sort(np.concatenate([h for _, h, _ in words(pa.array([" ".join(STOP_WORDS)]))]))


def statistics(texts: pa.Array) -> np.ndarray:
    """WIDTH figures of each whole text."""
    data, off = buffers(texts)
    n = len(off) - 1
    out = np.zeros((n, WIDTH))
    nbytes = np.diff(off)
    k = len(KINDS) + 1
    for first, h, woff in words(texts):
        m = len(woff) - 1
        lo, hi = off[first], off[first + m]
        doc = np.repeat(np.arange(m), nbytes[first : first + m])
        kinds = np.bincount(doc * k + _KIND[data[lo:hi]], minlength=m * k).reshape(m, k)
        size, count = np.maximum(nbytes[first : first + m], 1), np.diff(woff)
        many = np.maximum(count, 1)
        wdoc = np.repeat(np.arange(m), count)
        again = np.concatenate([[False], (h[1:] == h[:-1]) & (wdoc[1:] == wdoc[:-1])]) if len(h) else np.zeros(0, bool)
        stop = np.isin(h, STOPS)
        row = out[first : first + m]
        row[:, :k] = kinds / size[:, None]
        row[:, k] = np.log1p(nbytes[first : first + m])
        row[:, k + 1] = np.log1p(count)
        row[:, k + 2] = (size - kinds[:, 3] - kinds[:, 4]) / many
        row[:, k + 3] = np.bincount(wdoc, weights=again, minlength=m) / many
        row[:, k + 4] = np.bincount(wdoc, weights=stop, minlength=m) / many
        row[:, k + 5] = np.log1p(kinds[:, 4])
        row[:, k + 6] = np.log1p(count / (kinds[:, 4] + 1))
        # distinct words, pairs and runs of five
        for j, width in ((7, 1), (8, 2), (9, 5)):
            s = shingles(h, width)
            d = wdoc[: len(s)]
            keep = d == wdoc[width - 1 :][: len(s)]
            order = np.lexsort((s[keep], d[keep])) if keep.any() else np.zeros(0, np.int64)
            s, d = s[keep][order], d[keep][order]
            new = np.concatenate([[True], (s[1:] != s[:-1]) | (d[1:] != d[:-1])]) if len(s) else np.zeros(0, bool)
            row[:, k + j] = np.bincount(d, weights=new, minlength=m) / np.maximum(np.bincount(d, minlength=m), 1)
    return out


@dataclass
class Model:
    """What scoring needs; a few hundred kilobytes at any size of the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(cosines(self.standard(x)) @ self.weights, self.knots, self.values)

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -CLIP, CLIP)


def _random() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.normal(size=(WIDTH, FEATURES)) / np.sqrt(WIDTH), rng.uniform(0, 2 * np.pi, FEATURES)


def cosines(z: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised rows, and a constant."""
    w, phase = _random()
    return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(z @ w + phase), np.ones((len(z), 1))], axis=1)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of the least-squares increasing fit, pulled off 0 and 1 by half a row."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, rows, first and last score
    for s, t in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([t, 1, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2], b[3]]
    middle = np.array([(b[2] + b[3]) / 2 for b in blocks])
    value = np.array([(b[0] + 0.5) / (b[1] + 1) for b in blocks])
    value = np.maximum.accumulate(value)
    # outside the outer knots scores still differ a little
    knots = np.concatenate([[middle[0] - 3], middle, [middle[-1] + 3]])
    return knots, np.concatenate([[value[0] / 2], value, [(1 + value[-1]) / 2]])


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, bound: int) -> DataFrame:
    """(doc_id, text, y) of at most about bound labelled rows outside the held-out fold."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & (fold != held))
    n = rows.count()
    if n > bound:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * bound / n))
    # at most about bound rows of two numbers
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(rows), "doc_id")


def _sums(batches: Iterator[pa.RecordBatch], parts) -> Iterator[pa.RecordBatch]:
    """One row: the sum of parts(x, y) over a partition's rows."""
    total = None
    for batch in batches:
        x = np.array(batch.column("x").to_pylist()).reshape(len(batch), WIDTH)
        got = parts(x, batch.column("y").to_numpy())
        total = got if total is None else total + got
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sum"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the sum of the partitions' sums, in their order."""
    total = None
    for batch in batches:
        for x in batch.column("sum"):
            got = np.frombuffer(x.as_buffer())
            total = got if total is None else total + got
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sum"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held: int = 1, bound: int = SAMPLE) -> Model | None:
    """The model, or None without labelled rows."""
    from palimpsest.llm.scratch import Scratch

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(statistics(batch.column(1))), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    scratch = Scratch(docs.sparkSession, "quality")
    sample = labelled(docs, labels, label, folds, held, bound).select("doc_id", "text", "y").mapInArrow(rows, "doc_id long, y double, x array<double>")
    sample = scratch.save(sample.repartition(PARTS, "doc_id").sortWithinPartitions("doc_id", "y"), "sample")
    sample = sample.repartition(PARTS, "doc_id").sortWithinPartitions("doc_id", "y")
    fitted = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(4)) > 0

    def summed(df: DataFrame, parts, width: int) -> np.ndarray:
        each = df.select("x", "y").mapInArrow(lambda it: _sums(it, parts), "sum binary")  # a row for each of PARTS partitions
        got = each.repartition(1).sortWithinPartitions("sum").mapInArrow(_added, "sum binary").first()
        return np.frombuffer(got[0]) if got else np.zeros(width)

    moments = summed(sample, lambda x, y: np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)]), 1 + 2 * WIDTH)
    n = moments[0]
    if not n:
        return None
    mean = moments[1 : WIDTH + 1] / n
    scale = np.sqrt(np.maximum(moments[WIDTH + 1 :] / n - mean**2, 0))
    scale[scale < 1e-9] = 1.0
    model = Model(mean, scale, np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))
    d = FEATURES + 1

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        c = cosines(model.standard(x))
        return np.concatenate([(c.T @ c)[upper], c.T @ y])

    upper = np.triu_indices(d)
    sums = summed(sample.where(fitted), normal, len(upper[0]) + d)
    gram = np.zeros((d, d))
    gram[upper] = sums[:-d]
    gram = gram + np.triu(gram, 1).T
    model.weights = np.linalg.solve(gram + RIDGE * max(gram[-1, -1], 1) * np.eye(d), sums[-d:])
    rest = sample.where(~fitted).select("x", "y").orderBy("doc_id").collect() or sample.select("x", "y").orderBy("doc_id").collect()  # a quarter of the sample
    scores = cosines(model.standard(np.array([r[0] for r in rest]).reshape(-1, WIDTH))) @ model.weights
    model.knots, model.values = isotonic(scores, np.array([r[1] for r in rest]))
    return model


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, score)`` of every row."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    if model is None:
        return slim.select("doc_id", F.lit(0.5).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(statistics(batch.column(1))))], ["doc_id", "score"])
            release()

    return slim.mapInArrow(run, "doc_id long, score double")


def digest(scores: DataFrame, threshold: float, folds: int = 3, held: int = 1) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of scored rows."""
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds
    return scores.select("doc_id", (fold == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that the classifier accepts, with their own columns."""
    return filtered(docs, fit(docs, labels), lambda s: s >= threshold, statistics)


def filtered(docs: DataFrame, model, accepts, inputs) -> DataFrame:
    """The rows whose text's score is accepted; whole rows pass through the scoring task, so no join is needed."""
    if model is None:
        return docs
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            yield batch.filter(pa.array(accepts(model.score(inputs(texts)))))
            release()

    return docs.mapInArrow(run, docs.schema)
