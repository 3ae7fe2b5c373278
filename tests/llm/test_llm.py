"""The ten operators and the pipeline: SQL where it can express them, brute force and edge cases elsewhere."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from palimpsest.llm import bpe_duckdb, decontaminate, near_dup, pretok, quality_model, quality_rules, queries, sharding, suffix_lm, token_binary, token_counts, toxicity, wordvec
from tests.helpers import same

RANKS, TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TYPES = "doc_id long, text string, lang string, source string, score double, shard int, kept boolean, key string"


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and blank texts, ties, repeated rows, a very long text, and columns with clashing names."""
    texts = [None, "", "  \n\t ", "one", "one two", "same words here", "same words here", "Same words HERE", "it's 12½ — ñandú!\n\n  x", "x" * 3000, "long text of words " * 20_000, "日本語 🎉🎉 text"]
    rows = [(i, t, None if i % 3 else "en", None if i == 4 else "s", None, 1, None, "k") for i, t in enumerate(texts)]
    rows += [(5, "same words here", "en", "s", 0.5, 2, True, "k"), (None, "no id at all", "en", "s", 0.5, 2, True, "k")]
    return spark.createDataFrame(rows, TYPES).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], TYPES)


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_its_sql(spark, duck, sf, name):
    assert same(queries.QUERIES[name](spark, sf), duck.execute(queries.ORACLE_SQL[name])) > 0


# --- 1 ------------------------------------------------------------------------------

def test_rules_edges(edge, none):
    got = quality_rules.quality_rules(edge).collect()
    assert len(got) == edge.count()
    by = {r.doc_id: r for r in got}
    assert (by[0].n_words, by[0].word_chars, by[0].kept) == (0, 0, False)
    assert by[10].n_repeat_words == by[10].n_words == 80_000 and by[10].base_failed
    assert quality_rules.quality_rules(none).count() == 0
    assert quality_rules.apply_rules(edge).columns == edge.columns


def test_rules_are_native(edge):
    plan = edge.sparkSession._jvm.PythonSQLUtils.explainString(quality_rules.quality_rules(edge)._jdf.queryExecution(), "simple")
    assert "Python" not in plan and "Arrow" not in plan


# --- 2 ------------------------------------------------------------------------------

def brute_components(texts, k):
    """Components by all pairs, on word tuples."""
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    top = {i: i for i in texts}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(i for i in texts if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: find(i) for i in texts}, {i: len(s) for i, s in sets.items()}


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocab) for _ in range(rng.choice([3, 12, 60, 150]))] for _ in range(40)]
    texts = {}
    for i in range(400):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 1 + len(w) // 9)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts[i] = " ".join(w) if i % 7 else " ".join(w).upper()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    want, size = brute_components(texts, 2)
    got = {r.doc_id: r for r in near_dup.near_duplicates(docs, 2).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == size
    want5, _ = brute_components(texts, 5)
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs, 5).collect()} == want5


def test_near_duplicates_in_hot_nodes(spark, monkeypatch):
    """A group far above the limits of a node, branched and salted, is still one component."""
    monkeypatch.setattr(near_dup, "HOT", 30)
    monkeypatch.setattr(near_dup, "LEAF", 16)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(150):
        w = list(base)
        for _ in range(4):
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        texts[i] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want, _ = brute_components(texts, 2)
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs, 2).collect()} == want


def test_near_duplicates_whose_only_partner_is_in_another_salt(spark, monkeypatch):
    """In a single tree with nodes salted to single rows, a pair that shares its node is found."""
    dealt = near_dup._dealt
    monkeypatch.setattr(near_dup, "HOT", 1)
    monkeypatch.setattr(near_dup, "_dealt", lambda reps, *more: dealt(reps.withColumn("keys", F.slice("keys", 1, 1)), *more))
    core = [f"c{i}" for i in range(55)]
    texts = {}
    for i in range(200):
        own = [f"x{i}y{j}" for j in range(45)]
        texts[i], texts[500 + i] = " ".join(core + own), " ".join([*core, *own, "p"])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    path = dict(zip(texts, (tuple(near_dup.minwise(s)[near_dup.PATHS[0, :4]]) for s in wordvec.shingle_sets(pa.array(texts.values()), 2)), strict=True))
    want = {i: i - 500 if i >= 500 and path[i] == path[i - 500] else i for i in texts}
    assert max(Counter(path.values()).values()) > 10
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs, 2).collect()} == want


def test_near_duplicates_edges(edge, none):
    got = defaultdict(list)
    for r in near_dup.near_duplicates(edge, 2).collect():
        got[r.doc_id].append(r)
    assert all(r.n_shingles == 0 and r.component_id == i for i in (0, 1, 2) for r in got[i])
    assert {r.component_id for i in (5, 6, 7) for r in got[i]} == {5} and len(got[5]) == 2
    assert near_dup.near_duplicates(none, 2).count() == 0
    kept = near_dup.keep_one(edge, 2)
    assert kept.columns == edge.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([0, 1, 2, 3, 4, 5, 8, 9, 10, 11, None], key=str)


def test_components(spark):
    from palimpsest.llm.scratch import Scratch

    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (103, 103)]
    e = spark.createDataFrame(chain, "a long, b long")
    got = {r.id: r.label for r in near_dup.components(e, Scratch(spark, "test"), "t").collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


# --- 3, 7 -----------------------------------------------------------------------------

def held_out(out, labels, column, spark):
    rows = out.join(labels, "doc_id").where("held_out").select(column, "score", "predicted").collect()
    return [(r[0], r.score, r.predicted) for r in rows]


@pytest.mark.parametrize("number,column,least", [(3, "quality", 0.97), (7, "toxic", 0.93)])
def test_held_out_accuracy(spark, number, column, least):
    d = "/root/testdata/sf0.1"
    name = next(n for n in queries.QUERIES if n.startswith(f"op{number}_"))
    out = queries.QUERIES[name](spark, d).cache()
    assert out.count() == spark.read.parquet(f"{d}/documents.parquet").count()
    assert out.where("score < 0 OR score > 1 OR score IS NULL").isEmpty()
    assert out.where("doc_id < 3000").collect() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out.where("doc_id < 300").collect())
    rows = held_out(out, spark.read.parquet(f"{d}/labels.parquet"), column, spark)
    assert sum(y == p for y, _, p in rows) / len(rows) >= least
    out.unpersist()


@pytest.mark.parametrize("module,name", [(quality_model, "quality"), (toxicity, "toxic")])
def test_classifier_edges(spark, edge, none, module, name):
    labels = spark.createDataFrame([(i, None if i == 3 else i % 2, None if i == 3 else i % 2) for i in range(12)] + [(99, 1, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    model = module.fit(edge, labels)
    scores = module.score(edge, model).collect()
    assert len(scores) == edge.count() and all(0 <= r.score <= 1 for r in scores)
    assert module.score(none, model).count() == 0
    assert module.fit(edge, labels.limit(0)) is None
    assert module.score(edge, None).count() == edge.count()


def test_labels_of_the_held_out_fold_do_not_matter(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality_model.fit(docs, labels), quality_model.fit(docs, turned)
    assert np.allclose(a.weights, b.weights) and np.allclose(a.values, b.values)


def test_isotonic():
    x, y = np.array([3.0, 1.0, 2.0, 4.0]), np.array([0.0, 0.0, 1.0, 1.0])
    knots, values = quality_model.isotonic(x, y)
    assert (np.diff(values) >= 0).all() and (np.diff(knots) > 0).all() and 0 < values[0] and values[-1] < 1


def test_cosines_approximate_the_kernel():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(30, quality_model.WIDTH)) * 0.7
    c = quality_model.cosines(z)[:, :-1]
    d2 = ((z[:, None] - z[None]) ** 2).sum(axis=2)
    assert np.abs(c @ c.T - np.exp(-d2 / (2 * quality_model.WIDTH))).max() < 0.35


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    net = toxicity.Network.fresh()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.normal(size=(9, toxicity.WORD_DIM + toxicity.CHAR_DIM))
    index, mask = rng.integers(0, 9, (4, 6)), np.ones((4, 6), bool)
    mask[1, 4:] = False
    y, w = np.array([1.0, 0, 1, 0]), np.ones(4)
    _, g, dx = net.gradients(x, index, mask, y, w)

    def slope(a, i):
        old, out = a[i], []
        for step in (1e-3, -1e-3):
            a[i] = old + step
            out.append(net.gradients(x, index, mask, y, w)[0])
        a[i] = old
        return (out[0] - out[1]) / 2e-3

    for k, v in g.items():
        i = tuple(int(rng.integers(0, s)) for s in v.shape)
        assert slope(net.p[k], i) == pytest.approx(float(v[i]), abs=2e-4)
    assert slope(x, (3, 5)) == pytest.approx(float(dx[3, 5]), abs=2e-4)


def test_windows_are_all_windows():
    for n in (0, 1, 23, 24, 25, 36, 37, 100):
        off = np.array([0, 7, 7 + n])
        doc, first = toxicity._window_rows(off)
        assert [f - 7 for d, f in zip(doc, first, strict=True) if d == 1] == list(range(max(1, n - toxicity.SPAN + 1)))
        doc, first = toxicity._window_rows(off, 5)
        mine = [f - 7 for d, f in zip(doc, first, strict=True) if d == 1]
        assert mine[-1] == max(0, n - toxicity.SPAN) and max(np.diff(mine), default=0) <= 5


def test_scores_are_the_highest_of_all_windows(monkeypatch):
    """Against one window at a time, run without sharing anything; blocks of windows end inside texts."""
    monkeypatch.setattr(toxicity, "RUN", 16)
    rng = random.Random(6)
    words = [f"{rng.choice('abcdefgh')}{rng.choice('xyz') * rng.randint(1, 4)}" for _ in range(40)]
    texts = [" ".join(rng.choices(words, k=k)) for k in (0, 1, 5, 23, 24, 25, 26, 90, 3, 131)] + [None, "!?"]
    net = toxicity.Network.fresh(3)
    net.p["word"] *= 20
    got = toxicity.Scorer(net).highest(pa.array(texts, pa.string()))
    for text, high in zip(texts, got, strict=True):
        _, part, starts, last, hashes, _ = next(toxicity.tokens(pa.array([text or ""], pa.string())))
        x = net.inputs(hashes, *toxicity.word_grams(part, starts, last))
        logits = []
        for i in range(max(1, len(hashes) - toxicity.SPAN + 1)):
            own = x[i : i + toxicity.SPAN]
            logits.append(float(net.run(net.gates(own), np.arange(len(own))[None], np.ones((1, len(own)), bool))[0]) if len(own) else float(net.p["c"][0]))
        assert high == pytest.approx(max(logits), abs=1e-4)


# --- 4, 5, 8 -----------------------------------------------------------------------------

HARD = ["it's we'll they've I'm 'still ''s 's's  x\n\n  y \t z", "", "a  b", " lead", "trail  ", "x're'll", "don't 'd 'r 'rex", "é'sñ 12½ab ___!!! 　 x y", "'", " 's", "日本語 🎉🎉", "x" * 300 + " " + "ab" * 200, "\x1c\x1d a", "<|endoftext|>"]


def tiktoken_coding():
    import tiktoken

    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_duckdb.read_ranks(RANKS), special_tokens={})


def test_pretokens_equal_the_pattern(texts):
    import regex

    rx, rng = regex.compile(public_tokenizers.PATTERN), random.Random(1)
    some = HARD + list(texts.values())[:50] + ["".join(rng.choice(" '  abst relvdm\n\t12!.é² ") for _ in range(rng.randrange(60))) for _ in range(3000)]
    got = []
    for _, text, starts, _, off in pretok.pieces(pa.array(some)):
        ends = np.append(starts[1:], len(text))
        got += [[text[x:y] for x, y in zip(starts[a:b], ends[a:b], strict=True)] for a, b in zip(off[:-1], off[1:], strict=True)]
    assert got == [rx.findall(t) for t in some]


def test_bpe_equals_the_library(spark, edge, none, texts):
    coding = tiktoken_coding()
    docs = spark.createDataFrame(list(enumerate(HARD + [None] + list(texts.values())[:60])), "doc_id long, text string")
    want = {r.doc_id: coding.encode_ordinary(r.text or "") for r in docs.collect()}
    ids = bpe_duckdb.encode(docs, RANKS)
    assert {r.doc_id: list(r.ids) for r in ids.collect()} == want
    back = {r.doc_id: bytes(r.bytes) for r in bpe_duckdb.decode(ids, RANKS).collect()}
    assert back == {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in bpe_duckdb.digests(docs, RANKS).collect():
        assert r.n_tokens == len(want[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want[r.doc_id])).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(back[r.doc_id]).hexdigest()
    assert bpe_duckdb.digests(edge, RANKS).count() == edge.count()
    assert bpe_duckdb.digests(none, RANKS).count() == 0


def test_digests_decode_the_ids_of_whole_documents(spark, monkeypatch):
    """Ids put together wrongly show in the decoded bytes."""
    whole = bpe_duckdb.Codec.documents
    monkeypatch.setattr(bpe_duckdb.Codec, "documents", lambda self, texts: ((ids[::-1], *more) for ids, *more in whole(self, texts)))
    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    made = []
    monkeypatch.setattr(bpe_duckdb, "_partition", lambda path, make, names: made.append(make) or (lambda batches: batches))
    bpe_duckdb.digests(docs, RANKS)
    got = made[0](bpe_duckdb.codec_of(RANKS), pa.array(["one two three"]))
    assert got[2].to_pylist() == [hashlib.sha256(b" three twoone").hexdigest()]


def test_long_pieces_take_the_same_merges():
    codec, rng = bpe_duckdb.codec_of(RANKS), random.Random(2)
    words = ["".join(rng.choice("abehnrst") for _ in range(40)).encode() for _ in range(50)]
    ids, size = codec.encode_pieces(words)
    for w, part in zip(words, np.split(ids, np.cumsum(size)[:-1]), strict=True):
        assert codec._long(w).tolist() == part.tolist()


def test_new_pieces_of_several_runs_take_one_query(monkeypatch, texts):
    """Every piece is contracted once, and each step looks up the pairs that it made alone."""
    codec, coding = bpe_duckdb.Codec(RANKS), tiktoken_coding()
    some = [f"{t} zqwv{k}xkq qzqzqz" for k, t in enumerate(list(texts.values())[:12])]
    asked, whole = [], codec.encode_pieces
    codec.pieces.encode = lambda words: (asked.append(words), [whole([w.encode() for w in words])] * 2)[1]
    monkeypatch.setattr(pretok, "CHUNK", sum(map(len, some)) // 3)
    runs = len([*pretok.pieces(pa.array(some))])
    got = [ids.tolist() for ids, _ in codec.documents(pa.array(some))]
    assert got == [coding.encode_ordinary(t) for t in some]
    assert 1 < runs <= bpe_duckdb.RUNS and len(asked) == 1 and len(asked[0]) == len(set(asked[0]))


def test_contraction_takes_the_leftmost_of_equal_ranks(monkeypatch):
    codec, rng = bpe_duckdb.codec_of(RANKS), random.Random(5)
    words = ["".join(rng.choice("aehnt") * rng.randrange(1, 4) for _ in range(rng.randrange(1, 16))).encode() for _ in range(2000)] + [b"a" * 48, b"z", b"the"]
    monkeypatch.setattr(bpe_duckdb, "SQUARES", 40_000)  # several queries
    ids, size = codec.encode_pieces(words)
    for w, part in zip(words, np.split(ids, np.cumsum(size)[:-1]), strict=True):
        assert codec._long(w).tolist() == part.tolist()


def test_unknown_id_is_an_error():
    with pytest.raises(Exception, match="unknown token id"):
        bpe_duckdb.codec_of(RANKS).decode_lists(np.array([999_999]), np.array([1]))


def test_simple8b_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 1023, 1024, 1025, 5000):
        for high in (1, 2, 300, 50_257, 1 << 40, 1 << 63):
            x = rng.integers(0, high, n, dtype=np.uint64)
            if n > 10:
                x[3:200] = 0
            words, off = token_binary.pack(x)
            assert (token_binary.unpack(words, off, n) == x).all()
            if n:  # a block alone
                k = min(1, len(off) - 2)
                part = words[int(off[k]) : int(off[k + 1])]
                assert (token_binary.unpack(part, np.array([0, len(part)], np.uint64), min(1024, n - 1024 * k)) == x[1024 * k : 1024 * (k + 1)]).all()


def test_joined_pieces_have_their_own_ids(monkeypatch):
    """Letters after a space are given to the library together, all else apart; each keeps the ids that it has alone."""
    tok, table, _ = token_binary._tokenizer(TOKENIZER)
    words = [" the", "the", " zqwxv", " é", " naïveté", " 日本語", "'s", " 12", " don", " a", "\n\n", "  ", " ", " ǅ", " x²", "ÿ", " ꙮ", " !", " thhawh", " <|endoftext|>"]
    monkeypatch.setattr(token_binary, "JOINED", 3)

    class Counted:
        given = 0

        def encode_batch_fast(self, texts, **options):
            Counted.given += len(texts)
            return tok.encode_batch_fast(texts, **options)

        def __getattr__(self, name):
            return getattr(tok, name)

    monkeypatch.setattr("tokenizers.Tokenizer", type("T", (), {"from_file": staticmethod(lambda path: Counted())}))
    for some in (words, words[::-1], words[1:2], words[:1]):
        Counted.given = 0
        [(flat, size)] = token_binary._tokenizer.__wrapped__(TOKENIZER)[1].encode(some)
        assert [x.tolist() for x in np.split(flat, np.cumsum(size)[:-1])] == [tok.encode(w, add_special_tokens=False).ids for w in some]
        assert len(some) < 3 or Counted.given < len(some) - 4


def test_token_files(spark, edge, none, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    texts = texts | {10**6 + k: t for k, t in enumerate([None, "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y <|endoftext", "|> <|endof", "text|>", ""])}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(5)
    got = token_binary.token_files(docs, TOKENIZER, file_ids=20_000).orderBy("doc_id").collect()
    at = 0
    for r in got:
        ids = np.array([*tok.encode(texts.get(r.doc_id) or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(got) == len(texts)
    e = token_binary.token_files(edge, TOKENIZER).collect()
    assert len(e) == edge.count() and sum(r.doc_id is None for r in e) == 1
    assert {r.start + r.n_tokens for r in e} - {r.start for r in e} == {sum(r.n_tokens for r in e)}
    assert token_binary.token_files(none, TOKENIZER).count() == 0


def test_trees_equal_recounts():
    counter, coding, rng = token_counts._counter(RANKS), tiktoken_coding(), random.Random(4)
    letters = " '  abst relv\n\t12!.é"
    draw = lambda n: "".join(rng.choice(letters) for _ in range(n))
    for _ in range(400):
        text = draw(rng.choice([0, 1, 5, 40, 3000]))
        ((chars, tokens),) = counter.leaves(pa.array([text]))
        tree = token_counts.Tree(text, chars.tolist(), tokens.tolist())
        for _ in range(4):
            a, b, new = rng.randint(-2, len(text) + 3), rng.randint(0, len(text) + 3), draw(rng.choice([0, 1, 3, 700]))
            start = min(max(a, 0), len(text))
            text = text[:start] + new + text[min(max(b, start), len(text)) :]
            tree.edit(a, b, new, counter)
            assert tree.text == text and tree.total == len(coding.encode_ordinary(text)) and sum(tree.pairs()[0]) == len(text)


def test_edits_touch_little(spark, sf):
    out = token_counts.edited_counts(token_counts.sample_edits(spark.read.parquet(f"{sf}/documents.parquet")), RANKS).collect()
    assert sum(r.n_reencoded for r in out) < 0.2 * sum(r.n_pretokens for r in out)
    rows = {r.doc_id: r for r in token_counts.sample_edits(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    coding = tiktoken_coding()
    for r in out[:80]:
        text = rows[r.doc_id].text
        assert r.n_tokens == len(coding.encode_ordinary(text))
        for e in rows[r.doc_id].edits:
            start = min(max(e.start, 0), len(text))
            text = text[:start] + (e.replacement or "") + text[min(max(e.stop, start), len(text)) :]
        assert r.n_tokens_edited == len(coding.encode_ordinary(text))


def test_count_edges(spark, edge, none):
    edits = spark.createDataFrame([(5, 1, 0, 4, None), (5, 2, 0, 0, "New "), (6, 1, None, 3, "x"), (None, 1, 0, 1, "x"), (77, 1, 0, 1, "x")], "doc_id long, seq long, start long, stop long, replacement string")
    trees = token_counts.build_trees(edge, RANKS)
    assert trees.count() == edge.count()
    after = [r for r in token_counts.edit_trees(trees, edits, RANKS).collect() if r.doc_id == 5]
    assert {r.text for r in after} == {"New  words here"} and len(after) == 2
    got = token_counts.edited_counts(token_counts.sample_edits(edge), RANKS)
    assert got.count() == edge.count() and token_counts.edited_counts(token_counts.sample_edits(none), RANKS).count() == 0


# --- 6 ---------------------------------------------------------------------------------------

def test_base_scores_against_counts(spark, sf, texts):
    tokens = {i: [*WORD.findall((t or "").translate(LOWER)), None] for i, t in texts.items()}
    c = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(c.values()), len(c)
    rows = queries.QUERIES["op6_suffix_lm"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens[r.doc_id]), sum(c[w] > 0 for w in tokens[r.doc_id]), n)
        assert r.base_score == pytest.approx(want, rel=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_context_model_learns(spark):
    """Alternating words are nearly certain given the word before."""
    train = [(i, "a b " * 50 + ("c " if i % 2 else "d ")) for i in range(200)]
    x, y = [i for i in range(10_000, 10_100) if zlib.crc32(str(i).encode()) % 10 == 0][:2]  # held out
    ask = [(x, "a b " * 30), (y, "b b " * 30)]
    docs = spark.createDataFrame(train + ask, "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_lm.score_texts(docs).collect()}
    assert got[x].held_out and got[x].score > got[y].score + 4
    assert got[x].score > got[x].base_score


def test_rare_contexts_stay_states_in_a_large_corpus(spark):
    """A word seen 20 times among 700,000 still predicts its follower."""
    rng = random.Random(3)
    learn = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 10][:90]
    vocab = [f"w{i}" for i in range(60)]
    train = [(i, " ".join(rng.choices(vocab, k=10_000))) for i in learn[:70]] + [(i, "alpha beta") for i in learn[70:]]
    ask = next(i for i in range(10_000, 10_100) if zlib.crc32(str(i).encode()) % 10 == 0)
    docs = spark.createDataFrame([*train, (ask, "alpha beta")], "doc_id long, text string")
    got = next(r for r in suffix_lm.score_texts(docs).collect() if r.doc_id == ask)
    assert got.held_out and got.train_tokens > 700_000
    assert got.score > got.base_score + 3


def test_lm_edges(edge, none):
    rows = suffix_lm.score_texts(edge).collect()
    assert len(rows) == edge.count() and all(r.score <= 0 and math.isfinite(r.score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (0, 1, 2)} == {1}
    assert suffix_lm.score_texts(none).count() == 0


# --- 9 ---------------------------------------------------------------------------------------

def brute_cover(item, doc, match):
    """Greedy string tiling by definition."""
    mine, theirs, covered = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and i + n not in mine and j + n not in theirs:
                    n += 1
                best = max(best, (n, -i, -j))
        if best[0] < match:
            return covered
        n, i, j = best[0], -best[1], -best[2]
        mine |= set(range(i, i + n))
        theirs |= set(range(j, j + n))
        covered += n


def test_tiling_against_definition(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(30)]
    items = [[rng.choice(vocab) for _ in range(rng.randrange(2, 25))] for _ in range(12)]
    docs = []
    for _ in range(60):
        it = rng.choice(items)
        cut = rng.randrange(len(it) + 1)
        docs.append([rng.choice(vocab) for _ in range(5)] + it[cut:] + [rng.choice(vocab)] * rng.randrange(3) + it[:cut] + [rng.choice(vocab) for _ in range(4)])
    d = spark.createDataFrame([(i, " ".join(w).title()) for i, w in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(i, ", ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.matched_words for r in decontaminate.leaks(d, b, 3, 60).collect()}
    want = {(i, j): c for i, w in enumerate(docs) for j, it in enumerate(items) if it and 100 * (c := brute_cover(it, w, 3)) >= 60 * len(it)}
    assert set(got) == set(want)
    assert sum(got.values()) == pytest.approx(sum(want.values()), rel=0.03)  # equally long matches may be taken in another order


def test_decontamination_edges(spark, edge, none, sf, texts, monkeypatch):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    exact = {(i, r.item_id) for r in bench.collect() for i, t in texts.items() if r.text in t}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert exact <= got and len(got) <= len(exact) + 3
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2000)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()} == got
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (4, "Same words here")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(edge, items).collect()} == {(5, 4), (6, 4), (7, 4)}
    clean = decontaminate.clean(edge, items)
    assert clean.columns == edge.columns and clean.count() == edge.count() - 4
    assert decontaminate.leaks(none, items).count() == 0 == decontaminate.leaks(edge, items.limit(0)).count()


# --- 10 --------------------------------------------------------------------------------------

def test_sharding_law_and_mixture(spark, edge, none, sf, texts):
    rows = queries.QUERIES["op10_sharding"](spark, sf).collect()
    assert len(rows) == len(texts)
    per = Counter(r.shard for r in rows)
    assert set(per) <= set(range(8)) and max(per.values()) - min(per.values()) <= 1
    for s in per:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(per[s]))
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.law == "rows" and r.grown_shard is None for r in rows)
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    total, inside = Counter(source.values()), Counter((r.shard, source[r.doc_id]) for r in rows)
    assert all(abs(inside[s, c] - n / 8) <= 2 for c, n in total.items() for s in range(8))
    e = sharding.shard_table(edge).collect()
    assert len(e) == edge.count() and [r.size for r in e if r.doc_id == 0] == [1]
    assert sharding.shard_table(none).count() == 0


def test_written_shards_hold_every_row_once(spark, edge, tmp_path):
    """Repeated and null ids take a place each; clashing columns are kept under another name."""
    sharding.write_shards(edge, str(tmp_path / "out"), 4)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {*out.columns} == {*edge.columns} - {"shard"} | {"shard", "shard_", "slot"}
    rows = out.collect()
    assert sorted(((r.doc_id, r.text, r.shard_) for r in rows), key=str) == sorted(((r.doc_id, r.text, r.shard) for r in edge.collect()), key=str)
    per = Counter(r.shard for r in rows)
    assert max(per.values()) - min(per.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(per[s])) for s in per)


def test_sharding_is_the_same_in_any_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a, b = (sorted(sharding.shard_table(x).select("doc_id", "shard", "slot").collect()) for x in (docs, docs.repartition(7)))
    assert a == b


def test_sharding_against_plain_ranks(spark, sf):
    """The order by plain sorting on the driver."""
    docs = [(r.doc_id, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    by = defaultdict(list)
    for i, s in docs:
        by[s].append((hashlib.md5(f"20:{i}".encode()).hexdigest(), i))
    order = sorted(((2 * k + 1) / (2 * len(v)), f"s:{s}", h, i) for s, v in by.items() for k, (h, i) in enumerate(sorted(v)))
    want, at = {}, 0
    for shard in range(8):
        for slot in range(len(docs) // 8 + (shard < len(docs) % 8)):
            want[order[at][3]] = (shard, slot)
            at += 1
    got = {r.doc_id: (r.shard, r.slot) for r in queries.QUERIES["op10_sharding"](spark, sf).collect()}
    assert got == want


# --- words and the pipeline ---------------------------------------------------------------------

def test_words_equal_the_pattern(texts):
    some = [None, "", " a\x0bB\x0c ", "x", *list(texts.values())[:40]]
    got, seen = [], {}
    for _, h, off in wordvec.words(pa.array(some)):
        got += [h[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)]
    for t, hashes in zip(some, got, strict=True):
        w = WORD.findall((t or "").translate(LOWER))
        assert len(w) == len(hashes)
        for x, h in zip(w, hashes, strict=True):
            assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    state = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, state, d)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / str(k)))
        before, after = state, spark.read.parquet(str(tmp_path / str(k)))
        if name == "near-dedup":
            want, _ = brute_components({r.doc_id: r.text for r in before.collect()}, 5)
            assert {r.doc_id for r in after.collect()} == {i for i, top in want.items() if i == top}
        if name == "decontamination":
            bench = [r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
            held = {r.doc_id for r in before.collect() if any(b in r.text for b in bench)}
            assert {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()} >= held
        if name == "byte-level BPE":
            assert {r.doc_id: r.decoded_sha256 for r in after.collect()} == {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in before.collect()}
        else:
            assert 0 < after.count() <= before.count()
        state = after
    assert {r.doc_id for r in corpus_pipeline.run(spark, d).collect()} == {r.doc_id for r in state.collect()}


def test_pipeline_on_an_empty_table(spark, none, sf):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0
