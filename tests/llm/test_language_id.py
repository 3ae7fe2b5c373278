"""The language filter against exact sets, its accuracy on held-out rows, and its edge cases."""

import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import language_id as L

TYPES = "doc_id long, text string, lang string, source string, score double, lang_pred int"


def plain_grams(text):
    words, word = [], ""
    for c in text + " ":
        if c.isalpha() or unicodedata.category(c)[0] == "M":
            word += c.lower() if len(c.lower()) == 1 else c
        elif word:
            words.append(f"\0{word}\0")
            word = ""
    return [w[i : i + k] for w in words for k in L.ORDERS for i in range(len(w) - k + 1)]


@pytest.fixture(scope="module")
def rows(spark, sf):
    return [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def test_equals_exact_sets(spark, sf, rows):
    """Without false positives the filter is a set of n-grams for each language."""
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    seen = {}
    for _, text, lang in learned:
        seen.setdefault(lang, Counter()).update(plain_grams(text))
    total = {x: sum(c.values()) for x, c in seen.items()}
    rate = lambda g, x: seen[x][g] / total[x]
    sets = {x: {g for g in seen[x] if rate(g, x) >= L.FLOOR and rate(g, x) >= L.RATIO * max(rate(g, y) for y in seen)} for x in seen}
    model = L.fit(spark.read.parquet(f"{sf}/documents.parquet"), ~L.is_held_out(F.col("doc_id")))
    assert model.languages == sorted(seen, key=lambda x: (-total[x], x))
    assert model.wrong.max() < 1e-5
    texts = [t for _, t, _ in rows]
    got = list(L.counts(pa.array(texts), model.table, len(model.languages)))
    n, hits = np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])
    for i, t in enumerate(texts):
        grams = plain_grams(t)
        want = [sum(g in sets[x] for g in grams) for x in model.languages]
        assert n[i] == len(grams) and (hits[i] >= want).all() and (hits[i] - want).sum() <= 1e-4 * len(grams) + 1


def test_held_out_accuracy(spark, sf, rows):
    out = L.digest(spark.read.parquet(f"{sf}/documents.parquet"))
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got, truth = out.collect(), {i: x for i, _, x in rows}
    held = [r for r in got if r.held_out]
    assert len(got) == len(rows) and {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got)


def test_false_positives_are_taken_off():
    """A language whose slots are nearly full holds every n-gram by chance; the corrected counts see through it."""
    rng = np.random.default_rng(3)
    table = np.zeros((1, L.SLOTS), dtype=np.uint64)
    table[0, rng.random(L.SLOTS) < 0.97] |= np.uint64(1)
    texts = pa.array(["some words of the second language and more of them " * 5])
    ((n, _, has),) = L.counts(texts, table, 2)
    for _, _, _, grams, _, _ in L._words(texts):
        for j in range(L.HASHES):
            slots = (grams + np.uint64(j) * ((grams >> np.uint64(32)) | np.uint64(1))) & np.uint64(L.SLOTS - 1)
            table[0, slots[: len(slots) * 19 // 20]] |= np.uint64(2)
    ((n, hits, has),) = L.counts(texts, table, 2)
    wrong = np.array([np.count_nonzero(table[0] & np.uint64(1 << i)) / L.SLOTS for i in (0, 1)]) ** L.HASHES
    assert hits[0, 0] > 0.8 * n[0]
    assert L.decide(L.Model(["first", "second"], table, wrong), n, hits, has)[0] == ["second"]


def test_more_languages_than_a_word(spark):
    """Seventy languages of words of their own take two masks; a shared word belongs to all."""
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    word = lambda i: alphabet[i % 26] * 2 + alphabet[i // 26] * 3 + alphabet[(i * 7) % 26]
    rows = [(i, f"{word(i)} {word(i)} zzqzz", f"l{i:02}", None, None, None) for i in range(70)]
    docs = spark.createDataFrame(rows, TYPES)
    model = L.fit(docs)
    assert model.table.shape == (2, L.SLOTS)
    ((n, hits, _),) = L.counts(pa.array(["zzqzz"]), model.table, 70)
    assert hits[0].min() >= n[0] - 3  # but for pairs that are twice as common in the words with zz
    assert {(r.lang, r.lang_pred) for r in L.identify(docs, model).collect()} == {(f"l{i:02}", f"l{i:02}") for i in range(70)}


def test_edges(spark):
    rows = [
        (0, None, "en"), (1, "", "en"), (2, " 123 ... \n", "de"), (3, "the cat and the hat", "en"), (4, "der Hund und die Katze", "de"), (5, "the cat and the hat", "en"),
        (6, "日本語", None), (7, "THE HAT", None), (None, "the cat", "xx"), (8, "the cat and " * 60_000, None), (9, "नमस्ते", "hi"), (10, "İ ß ŉ the", None),
    ]
    docs = spark.createDataFrame([(*r, "s", 0.5, 7) for r in rows], TYPES).repartition(3)
    model = L.fit(docs, F.col("doc_id").isNotNull())
    out = L.identify(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "source", "lang_pred", "score"]
    got = {r.doc_id: r for r in out.collect()}
    assert [got[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and got[2].score == 0
    assert (got[4].lang_pred, got[7].lang_pred, got[8].lang_pred, got[9].lang_pred) == ("de", "en", "en", "hi")
    assert (got[6].lang_pred, got[6].score) == (model.languages[0], 0.0) and "xx" not in model.languages
    assert L.digest(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in L.identify(docs, L.fit(docs.limit(0))).collect()} == {"und"}
