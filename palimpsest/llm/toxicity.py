"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Words are runs of letters and digits, Latin capitals lowered. A word's input is
an embedding of the word and the mean of embeddings of its character n-grams; the
gates' input products are computed once for each distinct word. Every window of
``SPAN`` words, one from each word on, runs through a
forward and a backward gated recurrent layer; attention weighs the states, and
a logistic unit scores the pooled state. A text's score is its highest window's,
calibrated on labelled rows that the fit did not see.

Labels are per document, so training is by multiple instances: the windows of
toxic documents with the most telling words start as positives; after each
round, each document's highest windows under the network take their place, and
the highest windows of clean documents join the negatives. Examples are taken from every
``STEP``-th window; calibration and scoring go by all of them. The fit takes at
most about ``SAMPLE`` labelled rows and ``SAMPLE_BYTES`` of text, chosen by a hash
of the id among those whose text has ``TEXT_BYTES`` at most, never those of the
held-out fold. It runs in one task of an executor, which returns the weights. Word inputs are dropped at random in training, so the
characters alone must carry the decision for words not seen before.

Defined results: a null or wordless text has the score of a text without any
sign of toxicity; repeated rows each get a row; null labels are skipped; a null
id counts as the empty string for the fold; without labels of both kinds every
score is 0.0 (nothing toxic is known); extra columns are ignored; an empty table
gives none.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.quality_model import labelled
from palimpsest.llm.scratch import Scratch
from palimpsest.llm.wordvec import PLAIN, buffers, chunks, mix, release, span_hashes, word_spans

SPAN, STEP, HIDDEN = 24, 4, 8
WORD_DIM, CHAR_DIM, BUCKETS, GRAMS = 8, 16, 1 << 15, (3, 4, 5)
SAMPLE, ROUNDS, STEPS, BATCH, RATE = 4_000, 3, 120, 256, 0.01
SAMPLE_BYTES, TEXT_BYTES = 16 << 20, 1 << 18
KEEP_WORDS, RUN, SLICE = 200_000, 4096, 8192


def _fold_case(part: np.ndarray) -> np.ndarray:
    """Bytes with the capitals of ASCII and Latin-1 lowered."""
    out = part.copy()
    out[(part >= 65) & (part <= 90)] += 32
    lead = np.flatnonzero(part[:-1] == 0xC3)
    tail = part[lead + 1]
    out[lead[(tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)] + 1] += 32
    return out


def tokens(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first document, lowered bytes, word starts, last bytes, word hashes, n + 1 word offsets)."""
    data, off = buffers(texts)
    for i, j in chunks(off):
        part, o = _fold_case(data[off[i] : off[j]]), off[i : j + 1] - off[i]
        if not len(part):
            none = np.zeros(0, np.int64)
            yield i, part, none, none, np.zeros(0, np.uint64), np.zeros(j - i + 1, np.int64)
            continue
        starts, last, woff = word_spans(part, o, PLAIN)
        yield i, part, starts, last, span_hashes(part.astype(np.uint64) + np.uint64(1), starts, last), woff


def word_grams(part: np.ndarray, starts: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, their number per word) of the n-grams of words with a mark at both ends."""
    size = last - starts + 1
    wide = size + 2
    ends = np.cumsum(wide)
    text = np.full(int(ends[-1]) if len(ends) else 0, 300, dtype=np.uint64)
    inner = np.repeat(starts - (ends - wide) - 1, size)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(ends - wide + 1, size)
    text[at] = part[at + inner] + np.uint64(1)
    word = np.repeat(np.arange(len(size)), wide)
    keys, owner = [], []
    for n in GRAMS:
        begin = np.arange(len(text) - n + 1) if len(text) >= n else np.zeros(0, np.int64)
        begin = begin[word[begin] == word[begin + n - 1]] if len(begin) else begin
        keys.append(span_hashes(text, begin, begin + n - 1) if len(begin) else np.zeros(0, np.uint64))
        owner.append(word[begin])
    keys, owner = np.concatenate(keys), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return (mix(keys[order]) % np.uint64(BUCKETS)).astype(np.int64), np.bincount(owner, minlength=len(size))


def _window_rows(off: np.ndarray, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(document, first word) of the documents' windows, one each step words, the last flush with the end; one if there are fewer words."""
    n = np.diff(off)
    many = np.where(n <= SPAN, 1, -(-(n - SPAN) // step) + 1)
    doc = np.repeat(np.arange(len(n)), many)
    k = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    return doc, off[doc] + np.where(n[doc] <= SPAN, 0, np.minimum(k * step, n[doc] - SPAN))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def summed(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places and the sums of the values there."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], np.add.reduceat(values[order], first, axis=0)


@dataclass
class Network:
    """All weights. Direction d is 0 (forward) or 1 (backward)."""

    p: dict[str, np.ndarray] = field(default_factory=dict)
    calibration: tuple[float, float] = (1.0, 0.0)

    @classmethod
    def fresh(cls, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        h, x = HIDDEN, WORD_DIM + CHAR_DIM
        p = {"word": rng.normal(0, 0.1, (BUCKETS, WORD_DIM)), "char": rng.normal(0, 0.1, (BUCKETS, CHAR_DIM)), "a": rng.normal(0, 0.3, (2 * h, h)), "v": rng.normal(0, 0.3, h), "o": rng.normal(0, 0.3, 2 * h), "c": np.array([-1.0])}
        for d in "01":
            p |= {f"w{d}": rng.normal(0, x**-0.5, (x, 3 * h)), f"u{d}": rng.normal(0, h**-0.5, (h, 3 * h)), f"b{d}": np.zeros(3 * h)}
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    def inputs(self, hashes: np.ndarray, grams: np.ndarray, size: np.ndarray, word_kept: np.ndarray | None = None) -> np.ndarray:
        """Input vectors of words: embedding of the word, mean embedding of its n-grams."""
        w = self.p["word"][(hashes % np.uint64(BUCKETS)).astype(np.int64)]
        if word_kept is not None:
            w = w * word_kept[:, None]
        total = np.zeros((len(size), CHAR_DIM), np.float32)
        full = np.flatnonzero(size)
        if len(full):
            total[full] = np.add.reduceat(self.p["char"][grams], (np.cumsum(size) - size)[full], axis=0)
        return np.concatenate([w, total / np.maximum(size, 1)[:, None].astype(np.float32)], axis=1)

    def gates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' shares of the gates' sums, for both directions."""
        return x @ self.p["w0"] + self.p["b0"], x @ self.p["w1"] + self.p["b1"]

    def run(self, gates: tuple[np.ndarray, np.ndarray], index: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows. index, mask: (window, place) of words; keep: also what training needs."""
        h, (n, span) = HIDDEN, index.shape
        states = np.zeros((span, n, 2 * h), np.float32)
        saved = []
        for d in (0, 1):
            s, u = np.zeros((n, h), np.float32), self.p[f"u{d}"]
            for t in range(span) if d == 0 else range(span - 1, -1, -1):
                g, hu, m = gates[d][index[:, t]], s @ u, mask[:, t, None]
                zr = _sigmoid(g[:, : 2 * h] + hu[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                c = np.tanh(g[:, 2 * h :] + r * hu[:, 2 * h :])
                new = np.where(m, z * s + (1 - z) * c, s)
                if keep:
                    saved.append((d, t, s, z, r, c, hu[:, 2 * h :], m))
                s = new
                states[t, :, d * h : (d + 1) * h] = s
        e = np.tanh(states @ self.p["a"])
        q = np.where(mask.T, e @ self.p["v"], -1e9)
        w = np.exp(q - q.max(axis=0))
        w = (w * mask.T) / np.maximum((w * mask.T).sum(axis=0), 1e-9)
        pooled = (w[:, :, None] * states).sum(axis=0)
        logit = pooled @ self.p["o"] + self.p["c"][0]
        return (logit, (states, e, w, pooled, saved)) if keep else logit

    def slide(self, gates: tuple[np.ndarray, np.ndarray] | list[np.ndarray], words: np.ndarray) -> np.ndarray:
        """Logits of the full windows from each of the words on, as ``run`` computes them.

        A step's gate sums of consecutive windows are consecutive columns, so nothing is gathered a window.
        """
        h, n = HIDDEN, max(0, len(words) - SPAN + 1)
        out = np.empty(n, np.float32)
        half = np.repeat(np.array([0.5, 1], np.float32), [2 * h, h])  # the logistic function is taken as (1 + tanh(x / 2)) / 2
        back = [np.ascontiguousarray(self.p[f"u{d}"].T * np.float32(0.5)) for d in (0, 1)]
        attend = np.ascontiguousarray(self.p["a"].T)
        states = np.empty((SPAN, 2 * h, min(RUN, n)), np.float32)
        sums, c = np.empty((3 * h, min(RUN, n)), np.float32), np.empty((h, min(RUN, n)), np.float32)
        for k in range(0, n, RUN):
            m = min(RUN, n - k)
            if m < len(c[0]):
                sums, c = sums[:, :m].copy(), c[:, :m].copy()
            for d in (0, 1):
                g = np.ascontiguousarray((gates[d][words[k : k + m + SPAN - 1]] * half).T)
                s = np.zeros((h, m), np.float32)
                for t in range(SPAN) if d == 0 else range(SPAN - 1, -1, -1):
                    np.matmul(back[d], s, out=sums)
                    zr = sums[: 2 * h]
                    zr += g[: 2 * h, t : t + m]
                    np.tanh(zr, out=zr)
                    zr += 1
                    np.multiply(zr[h:], sums[2 * h :], out=c)
                    c += g[2 * h :, t : t + m]
                    np.tanh(c, out=c)
                    s -= c
                    s *= zr[:h]
                    s *= 0.5
                    s += c
                    states[t, d * h : (d + 1) * h, :m] = s
            now = states[:, :, :m]
            e = attend @ now
            np.tanh(e, out=e)
            q = self.p["v"] @ e
            w = np.exp(q - q.max(axis=0))
            out[k : k + m] = (w * (self.p["o"] @ now)).sum(axis=0) / w.sum(axis=0) + self.p["c"][0]
        return out

    def all_windows(self, gates, words: np.ndarray, off: np.ndarray, doc: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Logits of ``_window_rows(off)``; words: each word's row in gates."""
        out = np.full(len(doc), self.p["c"][0], np.float32)
        size = np.diff(off)[doc]
        full, short = np.flatnonzero(size >= SPAN), np.flatnonzero((size < SPAN) & (size > 0))
        if len(full):
            out[full] = self.slide(gates, words)[first[full]]  # those across two documents are left out
        for k in range(0, len(short), RUN):
            some = short[k : k + RUN]
            index = first[some, None] + np.arange(SPAN)
            out[some] = self.run(gates, words[np.minimum(index, len(words) - 1)], index < off[doc[some] + 1, None])
        return out

    def gradients(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray):
        """(loss, gradients of all but the embeddings, gradient of x)."""
        h = HIDDEN
        logit, (states, e, w, pooled, saved) = self.run(self.gates(x), index, mask, keep=True)
        prob = _sigmoid(logit)
        loss = float((weight * -(y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7))).sum())
        d = (weight * (prob - y)).astype(np.float32)
        g = {"o": pooled.T @ d, "c": np.array([d.sum()], np.float32)}
        dpool = d[:, None] * self.p["o"]
        dw = (states * dpool).sum(axis=2)
        dq = w * (dw - (w * dw).sum(axis=0))
        ds = w[:, :, None] * dpool
        g["v"] = (e * dq[:, :, None]).sum(axis=(0, 1))
        de = dq[:, :, None] * self.p["v"] * (1 - e * e)
        g["a"] = np.einsum("tnk,tnh->kh", states, de)
        ds = ds + de @ self.p["a"].T
        dgate = [np.zeros((*index.shape, 3 * h), np.float32) for _ in range(2)]
        du = [np.zeros((h, 3 * h), np.float32) for _ in range(2)]
        back = [np.zeros((len(y), h), np.float32) for _ in range(2)]
        for k, t, s, z, r, c, hc, m in reversed(saved):
            total = ds[t, :, k * h : (k + 1) * h] + back[k]
            inner = np.where(m, total, 0)
            dz = inner * (s - c) * z * (1 - z)
            dc = inner * (1 - z) * (1 - c * c)
            dr = dc * hc * r * (1 - r)
            dh = np.concatenate([dz, dr, dc * r], axis=1)
            dgate[k][:, t] = np.concatenate([dz, dr, dc], axis=1)
            du[k] += s.T @ dh
            back[k] = np.where(m, inner * z + dh @ self.p[f"u{k}"].T, total)
        dx = np.zeros_like(x)
        used, sums = summed(index.reshape(-1), np.concatenate(dgate, axis=2).reshape(index.size, 6 * h))
        whole = np.zeros((len(x), 6 * h), np.float32)
        whole[used] = sums
        dgate = [whole[:, : 3 * h], whole[:, 3 * h :]]
        for k in (0, 1):
            g |= {f"u{k}": du[k], f"w{k}": x.T @ dgate[k], f"b{k}": dgate[k].sum(axis=0)}
            dx += dgate[k] @ self.p[f"w{k}"].T
        return loss, g, dx


class Scorer:
    """A network with the gate products of the words that it met."""

    def __init__(self, net: Network):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.keys, self.slot, self.filled = np.zeros(0, np.uint64), np.zeros(0, np.int32), 0
        self.table = [np.zeros((1024, 3 * HIDDEN), np.float32) for _ in range(2)]

    def _add(self, gates: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Slots of new rows of the table, which grows by half."""
        end = self.filled + len(gates[0])
        if end > len(self.table[0]):
            for d in range(2):
                self.table[d].resize((max(end, len(self.table[d]) * 3 // 2), 3 * HIDDEN), refcheck=False)
        for d in range(2):
            self.table[d][self.filled : end] = gates[d]
        self.filled = end
        return np.arange(end - len(gates[0]), end, dtype=np.int32)

    def slots(self, part: np.ndarray, starts: np.ndarray, last: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        unique, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > KEEP_WORDS:
            self.clear()
        where = np.searchsorted(self.keys, unique)
        inside = where < len(self.keys)
        known = np.zeros(len(unique), bool)
        known[inside] = self.keys[where[inside]] == unique[inside]
        new = np.flatnonzero(~known)
        if len(new):
            slot = [np.zeros(0, np.int32)]
            for k in range(0, len(new), SLICE):
                some = new[k : k + SLICE]
                grams, size = word_grams(part, starts[at[some]], last[at[some]])
                slot.append(self._add(self.net.gates(self.net.inputs(unique[some], grams, size))))
            keys = np.concatenate([self.keys, unique[new]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.slot = keys[order], np.concatenate([self.slot, *slot])[order]
            where = np.searchsorted(self.keys, unique)
        return self.slot[where][inverse] if len(unique) else np.zeros(0, np.int32)

    def logits(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first document, window's document, window's first word, logits, word offsets) of runs of texts."""
        for i, part, starts, last, hashes, off in tokens(texts):
            slots = self.slots(part, starts, last, hashes)
            doc, first = _window_rows(off)
            out = self.net.all_windows(self.table, slots, off, doc, first)
            yield i, doc, first, out, off

    def highest(self, texts: pa.Array) -> np.ndarray:
        """Each text's highest logit over its windows."""
        out = np.zeros(len(texts))
        for i, doc, _, logit, off in self.logits(texts):
            out[i : i + len(off) - 1] = np.maximum.reduceat(logit, np.searchsorted(doc, np.arange(len(off) - 1)))
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        a, b = self.net.calibration
        return _sigmoid(a * self.highest(texts) + b).astype(float)


class _Corpus:
    """The sample's words as arrays: hashes, n-grams of distinct words, offsets."""

    def __init__(self, texts: list[str]):
        ids, offs, grams, sizes, self.unique = [], [np.zeros(1, np.int64)], [], [], np.zeros(0, np.uint64)
        runs = [*tokens(pa.array(texts, pa.string()))]
        self.unique = np.unique(np.concatenate([r[4] for r in runs])) if runs else self.unique
        done = np.zeros(len(self.unique), bool)
        where = []
        for _, part, starts, last, hashes, off in runs:
            ids.append(np.searchsorted(self.unique, hashes))
            offs.append(off[1:] + sum(map(len, ids[:-1])))
            u, at = np.unique(ids[-1], return_index=True)
            fresh = ~done[u]
            g, s = word_grams(part, starts[at[fresh]], last[at[fresh]])
            done[u[fresh]] = True
            where.append(u[fresh])
            grams.append(g.astype(np.int32))
            sizes.append(s)
        self.id = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        self.off = np.concatenate(offs)
        size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        start = np.cumsum(size) - size
        order = np.argsort(np.concatenate(where)) if where else []
        self.grams, self.size, self.start = (np.concatenate(grams) if grams else size), size[order], start[order]

    def rows(self, first: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        index = first[:, None] + np.arange(SPAN)
        mask = index < self.off[doc + 1][:, None]
        return self.id[np.minimum(index, len(self.id) - 1)], mask

    def gather(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[words]
        ahead = np.cumsum(size) - size
        return self.grams[np.repeat(self.start[words] - ahead, size) + np.arange(int(size.sum()))], size


def _odds(yes: np.ndarray, no: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log odds of toxic documents from counts of documents, shrunk where they are few."""
    rate = np.log((yes + 0.5) / (y.sum() + 1)) - np.log((no + 0.5) / (len(y) - y.sum() + 1))
    return rate * (yes + no) / (yes + no + 5)


def telling(corpus: _Corpus, y: np.ndarray, use: np.ndarray) -> np.ndarray:
    """How much each distinct word, or its most telling n-gram, speaks for toxic documents among those in use."""
    n = len(corpus.unique)
    words, grams = np.zeros((2, n)), np.zeros((2, BUCKETS))
    for i in np.flatnonzero(use).tolist():
        mine = np.unique(corpus.id[corpus.off[i] : corpus.off[i + 1]])
        words[int(y[i]), mine] += 1
        grams[int(y[i]), np.unique(corpus.gather(mine)[0])] += 1
    word, gram = _odds(words[1], words[0], y[use]), _odds(grams[1], grams[0], y[use])
    for k in range(0, n, SLICE):
        g, s = corpus.gather(np.arange(k, min(n, k + SLICE)))
        full = np.flatnonzero(s)
        if len(full):
            part = word[k : k + SLICE]
            part[full] = np.maximum(part[full], np.maximum.reduceat(gram[g], (np.cumsum(s) - s)[full]))
    return word


def train(texts: list[str], y: np.ndarray, rounds: int = ROUNDS, steps: int = STEPS, seed: int = 11) -> Network | None:
    """A network fitted to whole documents' labels; None unless both kinds occur."""
    y = np.asarray(y, dtype=np.float64)
    if not 0 < y.sum() < len(y):
        return None
    rng, held = np.random.default_rng(seed), np.arange(len(y)) % 4 == 3
    if not 0 < y[held].sum() < held.sum() or not 0 < y[~held].sum() < (~held).sum():
        held = np.zeros(len(y), bool)
    corpus, net = _Corpus(texts), Network.fresh(seed)
    if not len(corpus.id):
        return None
    doc, first = _window_rows(corpus.off, STEP)
    learn = ~held[doc] & (np.diff(corpus.off)[doc] > 0)
    word = telling(corpus, y, ~held)
    total = np.concatenate([[0], np.cumsum(np.maximum(word[corpus.id], 0) ** 2)])
    end = np.minimum(first + SPAN, corpus.off[doc + 1])
    view = total[end] - total[first]  # where the telling words are, at first
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for r in range(rounds):
        best = np.full(len(y), -np.inf)
        np.maximum.at(best, doc, view)
        cut = 0.5 * best[doc] if r == 0 else np.minimum(best[doc] - 1e-6, 2.0)
        plus = np.flatnonzero(learn & (y[doc] == 1) & (view >= cut) & (view >= best[doc] if r == 0 else True))
        clean = np.flatnonzero(learn & (y[doc] == 0))
        hard = clean[np.argsort(-view[clean], kind="stable")[: 2 * len(plus)]]
        minus = np.concatenate([hard, rng.choice(clean, min(len(clean), 3 * len(plus)), replace=False)]) if len(clean) else clean
        if not len(plus) or not len(minus):
            break
        for _ in range(steps):
            some = np.concatenate([rng.choice(plus, BATCH // 4), rng.choice(minus, BATCH - BATCH // 4)])
            target = (np.arange(BATCH) < BATCH // 4).astype(np.float64)
            index, mask = corpus.rows(first[some], doc[some])
            used, local = np.unique(index, return_inverse=True)
            grams, size = corpus.gather(used)
            kept = (rng.random(len(used)) > 0.5).astype(np.float32)
            x = net.inputs(corpus.unique[used], grams, size, kept)
            step += 1
            _, g, dx = net.gradients(x, local.reshape(index.shape), mask, target, np.full(BATCH, 1 / BATCH))
            slots = (corpus.unique[used] % np.uint64(BUCKETS)).astype(np.int64)
            dchar = np.repeat(dx[:, WORD_DIM:] / np.maximum(size, 1)[:, None], size, axis=0)
            for name, at, grad in (("word", slots, dx[:, :WORD_DIM] * kept[:, None]), ("char", grams, dchar)):
                where, total_grad = summed(at, grad)
                _adam(net.p[name], state[name], total_grad, step, where)
            for name, grad in g.items():
                _adam(net.p[name], state[name], grad, step)
        view = _all_logits(net, corpus, doc, first)
    use = held if held.any() else np.ones(len(y), bool)
    chosen = [texts[i] for i in np.flatnonzero(use)]
    scorer, top = Scorer(net), []
    for k in range(0, len(chosen), 256):
        top.append(scorer.highest(pa.array(chosen[k : k + 256], pa.string())))
    net.calibration = _platt(np.concatenate(top), y[use])
    return net


def _all_logits(net: Network, corpus: _Corpus, doc: np.ndarray, first: np.ndarray) -> np.ndarray:
    n = len(corpus.unique)
    gates = np.empty((n, 3 * HIDDEN), np.float32), np.empty((n, 3 * HIDDEN), np.float32)
    for k in range(0, n, SLICE):
        grams, size = corpus.gather(np.arange(k, min(n, k + SLICE)))
        gates[0][k : k + SLICE], gates[1][k : k + SLICE] = net.gates(net.inputs(corpus.unique[k : k + SLICE], grams, size))
    out = np.zeros(len(doc))
    for k in range(0, len(doc), RUN):
        index, mask = corpus.rows(first[k : k + RUN], doc[k : k + RUN])
        out[k : k + RUN] = net.run(gates, index, mask)
    return out


def _adam(p: np.ndarray, state: tuple[np.ndarray, np.ndarray], grad: np.ndarray, step: int, at=slice(None)) -> None:
    m, v = state
    m[at] = 0.9 * m[at] + 0.1 * grad
    v[at] = 0.99 * v[at] + 0.01 * grad * grad
    p[at] -= RATE * (m[at] / (1 - 0.9**step)) / (np.sqrt(v[at] / (1 - 0.99**step)) + 1e-7)


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit, with targets a little off 0 and 1."""
    x = np.clip(x, -30, 30)
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = _sigmoid(a * x + b)
        w = p * (1 - p) + 1e-9
        hess = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        move = np.linalg.solve(hess, [((p - t) * x).sum(), (p - t).sum()])
        a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pickled network of all rows (text, y), which are the bounded sample in one task."""
    held = [*batches]
    net = train([x or "" for b in held for x in b.column(0).to_pylist()], np.concatenate([b.column(1).to_numpy() for b in held])) if held else None
    del held
    release()
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], ["net"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held: int = 1, bound: int = SAMPLE) -> Network | None:
    """The network, trained in one task on at most about bound labelled texts and SAMPLE_BYTES."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = labelled(docs, labels, label, folds, held, bound).select("doc_id", "text", "y").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= TEXT_BYTES)
    sample = scratch.save(sample, "sample")
    total = sample.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > SAMPLE_BYTES:
        sample = sample.where(F.pmod(F.xxhash64("doc_id", F.lit("bytes")), F.lit(1_000_000)) < int(1_000_000 * SAMPLE_BYTES / total))
    rows = sample.repartition(1).sortWithinPartitions("doc_id", "y", "text").select("text", "y")
    found = rows.mapInArrow(_trained, "net binary").first()  # one row of a few megabytes
    scratch.drop("sample")
    return pickle.loads(found[0]) if found else None


def score(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, score)`` of every row."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    if net is None:
        return slim.select("doc_id", F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few megabytes at any size of the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.score(batch.column(1)))], ["doc_id", "score"])
            release()
        scorer.clear()
        release()

    return slim.mapInArrow(run, "doc_id long, score double")


def keep_civil(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that are not scored toxic, with their own columns."""
    net = fit(docs, labels)
    if net is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(scorer.score(batch.column(at)) < threshold))
            release()
        scorer.clear()
        release()

    return docs.mapInArrow(run, docs.schema)
