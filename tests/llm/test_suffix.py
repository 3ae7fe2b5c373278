"""The suffix tree against its definition, by plain counting."""

import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from palimpsest.llm import suffix_lm as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Brute:
    """All counts and states on one machine."""

    def __init__(self, docs, depth, hot_rest=None):
        self.depth = depth
        train = [self.tokens(t) for i, t in docs if zlib.crc32(str(i).encode()) % 10]
        self.n = Counter(w for ws in train for w in ws)
        self.total, self.kinds = sum(self.n.values()), len(self.n)
        once, twice = (sum(v == k for v in self.n.values()) for k in (1, 2))
        self.spare = min(max(once / max(once + 2 * twice, 1), 0.05), 0.95)
        self.states = {}  # context: (occurrences, counts of next symbols)
        self.tried = set()
        for level in range(1, depth + 1):
            after = defaultdict(Counter)
            for ws in train:
                for t in range(level, len(ws)):
                    after[tuple(ws[t - level : t])][ws[t]] += 1
            fresh = {}
            for c, nxt in after.items():
                of = sum(nxt.values())
                if of < S.MIN or level > 1 and (c[1:] not in self.states or c[:-1] not in self.tried):
                    continue
                fresh[c] = nxt
            self.tried |= set(fresh)
            for c, nxt in fresh.items():
                of, k = sum(nxt.values()), len(nxt)
                gain = sum(m * (math.log((m - 1 - S.DISCOUNT) / (of - 1)) - math.log(self.p(c[1:], w))) if m > 1 else math.log(S.DISCOUNT * max(k - 1, 1) / (of - 1)) for w, m in nxt.items())
                if gain > S.PENALTY * math.log(of):
                    self.states[c] = nxt

    @staticmethod
    def tokens(text):
        return [*WORD.findall((text or "").lower()), "\n"]

    def p(self, context, w):
        """The probability of w after the longest state that ends the context; of the unknown symbol if w is new."""
        while context and context not in self.states:
            context = context[1:]
        if not context:
            return (self.n[w] - self.spare if self.n[w] else self.spare * self.kinds) / self.total
        nxt = self.states[context]
        of = sum(nxt.values())
        return max(nxt[w] - S.DISCOUNT, 0) / of + S.DISCOUNT * len(nxt) / of * self.p(context[1:], w)

    def score(self, text):
        ws = self.tokens(text)
        return sum(math.log10(self.p(self.longest(ws[max(0, t - self.depth) : t]), w)) for t, w in enumerate(ws))

    def longest(self, before):
        """The longest context all of whose shorter ones are states too."""
        out = ()
        for k in range(1, len(before) + 1):
            if tuple(before[-k:]) not in self.states:
                break
            out = tuple(before[-k:])
        return out


def corpus(n, seed=1):
    """Words that depend on the two words before."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)]
    docs = []
    for i in range(n):
        ws = rng.choices(vocab, k=2)
        for _ in range(rng.randrange(0, 60)):
            a, b = ws[-2:]
            sure = vocab[(7 * len(a) + int(a[1:] or 0) * 3 + int(b[1:] or 0) % 4) % 30] if a[0] == b[0] == "w" else "w1"
            ws.append(sure if rng.random() < 0.7 else "T" if rng.random() < 0.5 else rng.choice(vocab))
        docs.append((i, " ".join(ws) if i % 50 else None))
    return docs


@pytest.mark.parametrize("depth", [0, 1, 2, 3])
def test_scores_by_definition(spark, depth):
    docs = corpus(400)
    brute = Brute(docs, depth)
    assert depth == 0 or max(map(len, brute.states)) == min(depth, 2) or depth == 3
    got = S.score_texts(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), depth=depth).collect()
    assert len(got) == len(docs)
    text = dict(docs)
    for r in got:
        assert r.score == pytest.approx(brute.score(text[r.doc_id]), rel=2e-6)


def test_hot_contexts_small_pieces_and_many_buckets(spark, monkeypatch):
    """The limits decide where counts are summed, not what comes out. Workers are forked afterwards, so the driver's walk is called directly."""
    docs = corpus(300, 2)
    want = {i: Brute(docs, 2).score(t) for i, t in docs[:40]}
    for hot, piece, buckets in ((1 << 18, 1 << 23, 8), (20, 1 << 23, 8), (20, 700, 31), (1 << 18, 1, 3)):
        assert {i: pytest.approx(x, rel=2e-6) for i, x in want.items()} == {i: x for i, x in alone(docs, 2, hot, piece, buckets, monkeypatch).items() if i in want}


def alone(docs, depth, hot, piece, buckets, monkeypatch):
    """The operator's own steps in this process: pieces send, buckets sum, pieces walk."""
    import pyarrow as pa

    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "PIECE", piece)
    ids = pa.array([i for i, _ in docs], pa.int64())
    batch = pa.RecordBatch.from_arrays([pa.array([i // 170 for i, _ in docs], pa.int64()), pa.array([t for _, t in docs], pa.string()), ids, pa.array([zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in docs])], ["chunk", "text", "doc_id", "learn"])
    stored = {}
    monkeypatch.setattr(S, "read_answers", lambda folder, piece: stored[folder, piece])
    folders, root = [], None
    for level in range(depth + 1):
        rows = [r for b in S._sent(list(folders), root, buckets)(iter([batch.slice(0, 111), batch.slice(111)])) for r in b.to_pylist()]
        by, sums, hots, met, answers = defaultdict(list), [], defaultdict(list), set(), defaultdict(list)
        for r in rows:
            by[r["bucket"]].append(r)
        for b, some in by.items():
            for o in S._merged(level, buckets, b, [r["piece"] for r in some], [r["blob"] for r in some]):
                if "blob" in o:
                    answers[o["piece"]].append((o["bucket"], {"blob": o["blob"], "context": None, "keep": None}))
                elif not level:
                    sums.append([o[c] for c in ("of", "kinds", "once", "more")])
                elif "of" in o:
                    hots[o["context"]].append(o)
                else:
                    met.add((o["piece"], o["context"]))
        for p, c in met:
            total = [sum(o[x] for o in hots[c]) for x in ("kinds", "once", "more", "gain")]
            answers[p].append((-1, {"blob": None, "context": c, "keep": float(S.kept(hots[c][0]["of"], *total))}))
        root = root or S.Root(*map(sum, zip(*sums, strict=True)))
        folders.append(f"level-{level}")
        for p, x in answers.items():
            stored[folders[-1], p] = pa.Table.from_pylist([y for _, y in sorted(x, key=lambda z: z[0])], schema=pa.schema([("blob", pa.binary()), ("context", pa.int64()), ("keep", pa.float64())]))
        assert bool(met) == (hot == 20 and level > 0)
    return {r["doc_id"]: r["score"] for b in S._scored(folders, root, buckets)(iter([batch])) for r in b.to_pylist()}


def test_hot_contexts_by_sql(spark):
    """The test of a context that is spread over buckets, as an SQL expression, is the one of the others."""
    rng = random.Random(4)
    rows = [(float(rng.randrange(16, 500)), float(rng.randrange(1, 16)), float(rng.randrange(0, 16)), float(rng.randrange(0, 400)), rng.uniform(-50, 3000)) for _ in range(300)]
    got = spark.createDataFrame(rows, "of double, kinds double, once double, more double, gain double").selectExpr("*", S._kept_sql() + " AS keep").collect()
    want = [float(S.kept(*r)) for r in rows]
    assert 0 < sum(x == 0 for x in want) < len(want)
    assert [r.keep for r in got] == pytest.approx(want)


def test_each_distribution_sums_to_one():
    brute = Brute(corpus(400), 2)
    some = sorted(brute.states, key=lambda c: (len(c), c))
    assert {len(c) for c in some} == {1, 2}
    for c in ((), *some[:5], *some[-5:]):
        assert sum(brute.p(c, w) for w in [*brute.n, "never seen"]) == pytest.approx(1)


def test_packed_round_trip():
    import numpy as np

    columns = [np.array([1, 1 << 60], "<u8"), np.zeros(0, "<u4"), np.array([0.5, -2.0, 3.25], "<f4"), np.arange(70_000, dtype="<u4")]
    back = S.unpacked(S.packed(*columns), "<u8", "<u4", "<f4", "<u4")
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(columns, back, strict=True))


def test_sent_runs_come_back_and_are_small():
    """Ascending contexts and symbols go as differences, equal symbols' probabilities side by side."""
    import numpy as np

    rng = np.random.default_rng(3)
    for contexts in (0, 1, 400):
        context = np.sort(rng.integers(0, 1 << 64, contexts, dtype=np.uint64))
        size = rng.integers(1, 20, contexts).astype(np.uint32)
        symbol = np.concatenate([np.sort(rng.zipf(1.2, k).clip(0, 1 << 20)).astype(np.uint64) for k in size] or [context])
        n = rng.zipf(2.5, len(symbol)).clip(0, 1 << 20).astype(np.uint32)
        logs = rng.integers(0, 1 << 16, 1 << 21, dtype=np.uint16)[symbol.astype(np.int64)]
        columns = context, n[:contexts].astype(np.uint64), size, symbol, n, logs
        blob = S.sent(*columns)
        assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(S.received(blob), columns, strict=True))
    assert len(blob) < 0.8 * len(S.packed(*columns))


def test_a_piece_sends_symbols_in_order():
    import numpy as np

    rng = np.random.default_rng(4)
    context, symbol = rng.integers(0, 30, 3000).astype(np.uint64), rng.integers(0, 400, 3000).astype(np.uint64)
    level = S.Level(S.join_keys(context, symbol), np.ones(3000, bool), 5, context, np.full(3000, 100), np.full(3000, 0.25), symbol)
    assert (level.symbol[level.back] == symbol).all() and (level.context[level.back] == context).all()
    assert (np.diff(level.symbol.astype(np.int64))[np.setdiff1d(np.arange(len(level.n) - 1), level.runs - 1)] > 0).all()


def test_contexts_go_as_numbers(spark, monkeypatch):
    """A context of one word is its number, one of two words ascends by the last; neither takes the bytes of a hash."""
    import numpy as np

    took, sent = defaultdict(int), S.sent

    def counted(context, *rest):
        took["bytes"] += len(S.packed(S.steps(context))) - len(S.packed(context[:0]))
        took["contexts"] += len(context)
        return sent(context, *rest)

    monkeypatch.setattr(S, "sent", counted)
    rng = np.random.default_rng(6)
    words = (rng.zipf(1.3, (400, 300)) % 5000).tolist()
    alone([(i, " ".join(f"w{x}" for x in ws)) for i, ws in enumerate(words)], 2, 1 << 18, 1 << 23, 3, monkeypatch)
    assert took["contexts"] > 1000
    assert took["bytes"] < 3 * took["contexts"]


def test_order_of_keys_of_any_width():
    import numpy as np

    rng = np.random.default_rng(5)
    for context_bits, symbol_bits in ((20, 20), (64, 20), (64, 63), (1, 64)):
        bucket = rng.integers(0, 5, 4000).astype(np.uint16)
        context, symbol = (rng.integers(0, 1 << 64, 4000, dtype=np.uint64) >> np.uint64(64 - b) for b in (context_bits, symbol_bits))
        context[1000:] = context[:3000]
        order = S.ordered(bucket, context, symbol)
        assert (np.stack([x[order] for x in (bucket, context, symbol)]) == np.stack([x[np.lexsort((symbol, context, bucket))] for x in (bucket, context, symbol)])).all()
    assert (S.ordered(bucket[:0], context[:0], symbol[:0]) == np.zeros(0)).all()
    older, last = np.array([1, 2, 1 << 33, 1, 1 << 33], np.uint64), np.array([2, 1, 1, 1 << 33, 1 << 33], np.uint64)
    assert len(set(S.pairs(older, last).tolist())) == 5


def test_shuffle_files_go_with_their_job(spark, monkeypatch):
    """They don't wait for the driver's garbage to be collected; the session's own setting comes back."""
    dirs = [*spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    files = lambda: {p.name for d in dirs for p in Path(d).glob("*/shuffle_*")}
    before, left = files(), []

    def settle(_):
        for _ in range(50):
            if not files() - before:
                break
            time.sleep(0.1)
        left.append(files() - before)

    monkeypatch.setattr(S, "_settle", settle)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    S.score_texts(spark.createDataFrame(corpus(200), "doc_id long, text string").repartition(3))
    assert left == [set()] * 6
    assert spark.conf.get(key, None) == was
