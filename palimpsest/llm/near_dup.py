"""MinHash near-duplicates by a chosen-path similarity join.

Each distinct shingle set gets a signature of minwise values. In every one of
``TREES`` independent trees a document starts at the node of one minwise token
and, while its node holds more than ``LEAF`` documents, branches by the next
chosen minwise token. Small nodes are compared exhaustively on signatures, which
yields candidate pairs; every link is confirmed on full shingle sets. A pair at
similarity 0.8 shares a leaf of depth d in one tree with probability 0.8**d, so
16 trees miss it with probability 1e-7 at depth 2 and 1e-5 at depth 3.

A node never emits all its pairs. It emits a maximum spanning forest of its
candidate pairs; when one of those edges fails on full sets and its ends are not
joined otherwise, the node is read again: its documents with candidates in other
components are brought together with their texts, and all those pairs are
confirmed in place, so no candidate is dropped and only links are emitted. Nodes of one tree with
over ``HOT`` rows are branched further before they are dealt out, then salted,
with their pivot in each salt. A node that was salted, or a large leaf cut into
blocks, is read again in all its salts if its rows lie in more than one component,
with all rows outside its commonest component in every salt.

Defined results: a null or wordless text has an empty set and links with
nothing; texts with equal sets are one class (their smallest id stands for it);
repeated rows with one id give one row each; null ids keep a row of their own
with a null component; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.scratch import Scratch
from palimpsest.llm.wordvec import mix, release, shingle_sets

COORDS, TREES, LEAF, DEPTH = 64, 16, 128, 8
HOT, STAR = 20_000, 2_000
AGREE = 36  # of COORDS; a pair at 0.8 falls below with probability of about 1e-5
BROADCAST_IDS = 2_000_000  # 8 bytes each

_rng = np.random.default_rng(20)
_MULT = _rng.integers(0, 1 << 32, COORDS, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, COORDS, dtype=np.uint32)
#: The coordinates that each tree branches by, in turn; the first ones differ.
PATHS = np.stack([np.concatenate([[4 * t], _rng.permutation(np.delete(np.arange(COORDS), 4 * t))]) for t in range(TREES)])


def minwise(s: np.ndarray) -> np.ndarray:
    """COORDS minima of a set of 64-bit hashes under 32-bit permutations."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(COORDS, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(low, (x[i : i + 2048, None] * _MULT + _ADD).min(axis=0), out=low)
    return low


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = np.arange(TREES, dtype=np.uint64) << np.uint64(32)
        for batch in batches:
            size, digest, low = [], [], []
            for s in shingle_sets(batch.column(1), k):
                size.append(len(s))
                digest.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                low.append(minwise(s))
            m = np.array(low, dtype=np.uint64).reshape(-1, COORDS)
            sig = (mix(m) >> np.uint64(56)).astype(np.uint8)
            keys = mix(m[:, PATHS[:, 0]] + trees + np.uint64(1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "sig", "keys"])
            release()

    return run


def whole_groups(batches: Iterator[pa.RecordBatch], key: int = 0, least: int = 20_000) -> Iterator[pa.Table]:
    """Tables of complete groups out of batches sorted by an integer column."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows < least:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        k = t.column(key).to_numpy()
        cut = int(np.searchsorted(k, k[-1], side="left")) if k[0] <= k[-1] else int(np.flatnonzero(k != k[-1])[-1]) + 1
        if cut:
            yield t.slice(0, cut)
        held = t.slice(cut).to_batches()
        rows = len(t) - cut
        least = max(20_000, 2 * rows)
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _leaves(group: np.ndarray, tree: np.ndarray, sig: np.ndarray, skip: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers of each leaf with two rows or more; deep ones may be large."""
    key = mix(group.astype(np.uint64))
    active = np.arange(len(key))
    for level in range(DEPTH + 1):
        order = active[np.argsort(key[active], kind="stable")]
        k = key[order]
        cuts = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
        sizes = np.diff(cuts)
        for i in np.flatnonzero((sizes > 1) & ((sizes <= LEAF) | (level == DEPTH))).tolist():
            yield order[cuts[i] : cuts[i + 1]]
        active = order[np.repeat(sizes > LEAF, sizes)]
        if not len(active):
            return
        token = sig[active, PATHS[tree[active], 1 + skip[active] + level]]
        key[active] = mix(key[active] * np.uint64(257) + token + np.uint64(1))


def agreements(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty((len(a), len(b)), dtype=np.uint8)
    step = max(1, (1 << 21) // (len(b) * COORDS + 1))
    for i in range(0, len(a), step):
        out[i : i + step] = np.count_nonzero(a[i : i + step, None, :] == b[None, :, :], axis=2)
    return out


def _forest(agree: np.ndarray) -> list[tuple[int, int]]:
    """A maximum spanning forest over pairs that agree often enough."""
    n = len(agree)
    out, left = [], np.ones(n, dtype=bool)
    best, parent = np.zeros(n, dtype=np.int16), np.full(n, -1)
    live = (agree >= AGREE).sum(axis=1) > 1
    left &= live
    while left.any():
        i = int(np.argmax(np.where(left, best, -1)))
        if best[i] >= AGREE:
            out.append((int(parent[i]), i))
        left[i] = False
        better = left & (agree[i] > best)
        best[better], parent[better] = agree[i][better], i
    return out


def _signature_rows(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype=np.uint8).reshape(-1, COORDS)


def _across(label: np.ndarray, sig: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows of other labels that agree often enough), for the rows outside the commonest label."""
    names, where, many = np.unique(label, return_inverse=True, return_counts=True)
    few = np.flatnonzero(where != np.argmax(many))
    for i in range(0, len(few) if len(names) > 1 else 0, 256):
        agree = agreements(sig[few[i : i + 256]], sig) >= AGREE
        for x, row in zip(few[i : i + 256].tolist(), agree, strict=True):
            others = np.flatnonzero(row & (label != label[x]))
            if len(others):
                yield x, others


def _candidates(again: bool):
    """Of each leaf, the pairs of a spanning forest, and a mark (agree -1) of each node not compared whole; or its documents with candidates in other components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            g, node, salted, tree, ids, skip, label = (t.column(c).to_numpy() for c in ("g", "node", "salted", "tree", "id", "skip", "label"))
            sig = _signature_rows(t)
            found: list[tuple[int, int, int, int]] = []
            partial = set() if again else set(node[salted].tolist())
            for rows in _leaves(g, tree, sig, skip):
                rows = rows[np.argsort(ids[rows], kind="stable")]
                rows = rows[np.concatenate([[True], ids[rows][1:] != ids[rows][:-1]])]
                if again:
                    mixed = np.zeros(len(rows), bool)
                    for x, others in _across(label[rows], sig[rows]):
                        mixed[x] = mixed[others] = True
                    rows = rows[mixed]
                    if len(rows):
                        name = mix(g[rows[:1]].astype(np.uint64) * np.uint64(31) + ids[rows[:1]].astype(np.uint64)).astype(np.int64)[0]
                        found += [(name, i, x, 0) for i, x in zip(ids[rows], label[rows], strict=True)]
                    continue
                if len(rows) > LEAF:
                    partial.add(int(node[rows[0]]))
                for i in range(0, len(rows), LEAF):
                    block = rows[i : i + LEAF]
                    if i:  # of a node that stays large: its first rows link the blocks
                        block = np.concatenate([rows[:4], block])
                    agree = agreements(sig[block], sig[block])
                    if np.count_nonzero(agree >= AGREE) > len(block):
                        found += [(min(ids[block[a]], ids[block[b]]), max(ids[block[a]], ids[block[b]]), int(agree[a, b]), node[block[a]]) for a, b in _forest(agree)]
            found += [(x, x, -1, x) for x in partial]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(x, dtype=np.int64)) for x in zip(*found, strict=True)], ["a", "b", "agree", "node"])
            release()

    return run


def _links(k: int, percent: int):
    """Links between the components of each group of (group, id, label, sig, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, least=2_000):
            group, ids, label, sig = t.column("group").to_numpy(), t.column("id").to_numpy(), t.column("label").to_numpy().copy(), _signature_rows(t)
            out: list[tuple[int, int, bool]] = []
            cuts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]]).tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                sets = [*shingle_sets(t.column("text").slice(a, b - a), k)]
                size = np.array([len(s) for s in sets])
                for x, others in _across(label[a:b].copy(), sig[a:b]):
                    others = others[label[a:b][others] != label[a + x]]  # joined meanwhile
                    others = others[100 * np.minimum(size[others], size[x]) >= percent * np.maximum(size[others], size[x])]
                    for i in range(0, len(others), 64):
                        some = others[i : i + 64]
                        each = np.concatenate([sets[y] for y in some])
                        at = np.minimum(np.searchsorted(sets[x], each), size[x] - 1)
                        both = np.add.reduceat(sets[x][at] == each, np.cumsum(size[some]) - size[some], dtype=np.int64)
                        for y in some[100 * both >= percent * (size[some] + size[x] - both)].tolist():
                            if label[a + y] != label[a + x]:
                                out.append((min(ids[a + x], ids[a + y]), max(ids[a + x], ids[a + y]), True))
                                label[a:b][label[a:b] == label[a + y]] = label[a + x]
            p, q, ok = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(q, pa.int64()), pa.array(ok, pa.bool_())], ["a", "b", "ok"])
            release()

    return run


def _confirm(k: int, percent: int):
    """Each star's pairs on full sets: its centre's row first, then the others'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, at = None, None
        for batch in batches:
            hub, salt, role, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            out = []
            for i, s in enumerate(shingle_sets(batch.column(4), k)):
                if role[i] == 0:
                    centre, at = s, (hub[i], salt[i])
                    continue
                assert at == (hub[i], salt[i]), "a star without its centre"
                both = len(centre) + len(s) - len(np.union1d(centre, s))
                out.append((hub[i], ids[i], 100 * both >= percent * (len(centre) + len(s) - both)))
            a, b, ok = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(ok, pa.bool_())], ["a", "b", "ok"])
            release()

    return run


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, label) of every id in the edges (a, b): its component's smallest id.

    Alternates large and small stars until the edges stay as they are; each
    round is a table on shared storage, checked by its count and checksum.
    """
    e = scratch.save(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    state, k = None, 0
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            break
        state, k = now, k + 1
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = scratch.save(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{k}")
        if k > 1:
            scratch.drop(f"{name}-{k - 2}")
    return e.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("label"))).distinct()


def _dealt(reps: DataFrame, scratch: Scratch, labels: DataFrame | None) -> DataFrame:
    """Rows (g, node, salted, tree, id, sig, skip, label), a node's rows under one g; hot nodes branched, then salted, a g for each salt."""
    rows = reps if labels is None else reps.join(labels, "id", "left")
    rows = rows.select("id", "sig", (F.coalesce("label", "id") if labels is not None else F.lit(-1).cast("long")).alias("label"), F.posexplode("keys").alias("tree", "key"))
    size = rows.groupBy("key").agg(F.count("*").alias("n"))
    hot = scratch.save(size.where(F.col("n") > HOT), "hot-again" if labels is not None else "hot")
    plain = [F.col("key").alias("g"), F.col("key").alias("node"), F.lit(False).alias("salted"), "tree", "id", "sig", F.lit(0).alias("skip"), "label"]
    if hot.isEmpty():
        return rows.select(*plain)
    cold = rows.join(hot, "key", "left_anti").select(*plain)
    paths = F.array(*[F.array(*[F.lit(int(c) + 1) for c in PATHS[t][1:4]]) for t in range(TREES)])
    warm = rows.join(hot.select("key"), "key").withColumn("c", paths[F.col("tree")])
    warm = warm.withColumn("g", F.expr("xxhash64(key, substring(sig, c[0], 1), substring(sig, c[1], 1), substring(sig, c[2], 1))"))
    warm = warm.select("g", "tree", "id", "sig", F.lit(3).alias("skip"), "label")
    per = warm.groupBy("g").agg(F.count("*").alias("n"), F.min(F.struct("id", "tree", "sig", "label")).alias("p"))
    per = per.select("g", "p", F.greatest(F.lit(1), F.ceil(F.col("n") / HOT)).alias("parts"))
    if labels is not None:
        common = warm.groupBy("g", "label").agg(F.count("*").alias("n")).groupBy("g").agg(F.max(F.struct("n", "label")).alias("c"))
        per = per.join(common.select("g", F.col("c.label").alias("common")), "g")
    warm = warm.join(per, "g")
    own = F.array(F.pmod(F.xxhash64("id", "g"), F.col("parts")))  # g differs by tree
    everywhere = F.expr("sequence(0L, parts - 1)")
    where = F.when(F.col("label") != F.col("common"), everywhere).otherwise(own) if labels is not None else own
    warm = warm.withColumn("part", F.explode(where))
    pivots = per.where("parts > 1").withColumn("part", F.explode(everywhere)).select("g", F.col("p.tree").alias("tree"), F.col("p.id").alias("id"), F.col("p.sig").alias("sig"), F.lit(3).alias("skip"), F.col("p.label").alias("label"), "part")
    warm = warm.select("g", "tree", "id", "sig", "skip", "label", "part", (F.col("parts") > 1).alias("salted")).unionByName(pivots.withColumn("salted", F.lit(True)))
    warm = warm.withColumn("node", F.col("g")).withColumn("g", F.when(F.col("part") > 0, F.xxhash64("g", "part")).otherwise(F.col("g")))
    return cold.unionByName(warm.drop("part"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, class_id, component_id, kept)``, one row for each row of docs."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dup")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = scratch.save(slim.mapInArrow(_signatures(k), "doc_id long, n_shingles long, digest binary, sig binary, keys array<long>"), "signed")
    full = signed.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    reps = full.groupBy("digest").agg(F.min(F.struct("doc_id", "sig", "keys")).alias("r"))
    reps = scratch.save(reps.select("digest", F.col("r.doc_id").alias("id"), "r.sig", "r.keys"), "reps")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pair_type = "a long, b long, agree long, node long"

    def bounded(ids: DataFrame) -> DataFrame:
        """A saved table of single ids, broadcast if it is small enough."""
        return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    def compared(rows: DataFrame, again: bool) -> DataFrame:
        rows = rows.repartition(width, "g").sortWithinPartitions("g")
        return rows.select("g", "node", "salted", "tree", "id", "sig", "skip", "label").mapInArrow(_candidates(again), pair_type)

    seen = scratch.save(compared(_dealt(reps, scratch, None), False), "candidates")
    partial = scratch.save(seen.where("agree < 0").select("node").distinct(), "partial")
    pairs = seen.where("agree >= 0").groupBy("a", "b").agg(F.max("agree").alias("agree"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "agree"))
    first = both.groupBy("a").agg(F.max(F.struct("agree", (-F.col("b")).alias("b"))).alias("m"))
    first = first.select(F.least(F.col("a"), -F.col("m.b")).alias("a"), F.greatest(F.col("a"), -F.col("m.b")).alias("b")).distinct()
    first = scratch.save(first, "first")
    texts = None

    def ids_of(p: DataFrame) -> DataFrame:
        return p.select(F.explode(F.array("a", "b")).alias("id")).distinct()

    def texts_of(ids: DataFrame, name: str) -> DataFrame:
        ids = scratch.save(ids, f"{name}-ids")
        small = bounded(ids)
        rows = slim.join(small, slim["doc_id"] == small["id"], "left_semi")
        return scratch.save(rows.dropDuplicates(["doc_id"]) if repeated else rows, name)

    def confirmed(p: DataFrame, name: str) -> DataFrame:
        parts = p.groupBy("a").agg(F.ceil(F.count("*") / STAR).alias("parts"))
        salted = p.join(parts, "a").select(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("parts")).alias("salt"), F.lit(1).alias("role"), F.col("b").alias("id"))
        centres = salted.select("hub", "salt").distinct().select("hub", "salt", F.lit(0).alias("role"), F.col("hub").alias("id"))
        rows = salted.unionByName(centres).join(texts, F.col("id") == texts["doc_id"]).select("hub", "salt", "role", "id", "text")
        rows = rows.repartition(width, "hub", "salt").sortWithinPartitions("hub", "salt", "role")
        return scratch.save(rows.mapInArrow(_confirm(k, percent), "a long, b long, ok boolean"), name)

    repeated = signed.count() != signed.select("doc_id").distinct().count()
    labels = None
    if not seen.isEmpty():
        texts = texts_of(ids_of(pairs), "texts")
        checked = confirmed(first, "confirmed-1")
        labels = scratch.save(components(checked.where("ok"), scratch, "c1"), "labels-1")

        def apart(p: DataFrame, lab: DataFrame) -> DataFrame:
            """Pairs not yet checked, whose ends have different labels, with those labels."""
            la, lb = lab.select(F.col("id").alias("a"), F.col("label").alias("x")), lab.select(F.col("id").alias("b"), F.col("label").alias("y"))
            p = p.join(la, "a", "left").join(lb, "b", "left")
            return p.withColumn("x", F.coalesce("x", "a")).withColumn("y", F.coalesce("y", "b")).where("x != y")

        def joined(lab: DataFrame, more: DataFrame, name: str) -> DataFrame:
            """Labels after the links of more, which are few."""
            links = apart(more.where("ok").select("a", "b"), lab).select(F.col("x").alias("a"), F.col("y").alias("b"))
            up = components(links, scratch, name).select(F.col("id").alias("label"), F.col("label").alias("top"))
            wide = lab.unionByName(more.where("ok").select(F.explode(F.array("a", "b")).alias("id")).distinct().join(lab, "id", "left_anti").select("id", F.col("id").alias("label")))
            return scratch.save(wide.join(up, "label", "left").select("id", F.coalesce("top", "label").alias("label")), f"labels-{name}")

        second = scratch.save(apart(pairs.select("a", "b").join(first, ["a", "b"], "left_anti"), labels).select("a", "b"), "second")
        if not second.isEmpty():
            more = confirmed(second, "confirmed-2")
            labels, checked = joined(labels, more, "c2"), checked.unionByName(more)
        failed = apart(checked.where("NOT ok").select("a", "b"), labels).select("a", "b")
        nodes = seen.where("agree >= 0").join(failed, ["a", "b"], "left_semi").select("node")
        dealt = None
        if not partial.isEmpty():  # compared in parts: again, unless one component holds all
            dealt = _dealt(reps, scratch, labels)
            spread = dealt.join(bounded(partial), "node", "left_semi").groupBy("node").agg(F.min("label").alias("low"), F.max("label").alias("high"))
            nodes = nodes.unionByName(spread.where("low != high").select("node"))
        nodes = scratch.save(nodes.distinct(), "nodes")
        if not nodes.isEmpty():
            dealt = _dealt(reps, scratch, labels) if dealt is None else dealt
            mixed = compared(dealt.join(bounded(nodes), "node", "left_semi"), True).select(F.col("a").alias("group"), F.col("b").alias("id"), F.col("agree").alias("label"))
            mixed = scratch.save(mixed, "mixed")
            if not mixed.isEmpty():
                ids = mixed.select("id").distinct()
                missing = scratch.save(ids.join(texts.select(F.col("doc_id").alias("id")), "id", "left_anti"), "missing")
                if not missing.isEmpty():
                    texts = texts.unionByName(texts_of(missing, "texts-2"))
                full_rows = mixed.join(texts, F.col("id") == texts["doc_id"]).join(reps.select("id", "sig"), "id")
                full_rows = full_rows.select("group", "id", "label", "sig", "text").repartition(width, "group").sortWithinPartitions("group", "id")
                found = scratch.save(full_rows.mapInArrow(_links(k, percent), "a long, b long, ok boolean"), "confirmed-3")
                labels = joined(labels, found, "c3")
        scratch.drop("texts", "texts-2")
    classes = reps.select("digest", "id")
    if labels is None:
        classes = classes.withColumn("label", F.col("id"))
    else:
        classes = classes.join(labels, "id", "left").select("digest", "id", F.coalesce("label", "id").alias("label"))
    out = signed.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("id", "doc_id").alias("class_id"), F.coalesce("label", "doc_id").alias("component_id"))
    out = scratch.save(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "result")
    scratch.drop("signed", "reps", "candidates", "first", "second", "mixed")
    return out


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without the near-duplicates of a smaller id; of repeated ids one row stays, null ids all."""
    found = near_duplicates(docs, k, percent)
    ids = found.select(F.col("doc_id").alias("_id"))
    gone = found.where("NOT kept").select(F.col("doc_id").alias("_id")).distinct()
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    rest = docs.join(gone, docs["doc_id"].cast("long") == gone["_id"], "left_anti")
    if ids.where("_id IS NOT NULL").count() == ids.where("_id IS NOT NULL").distinct().count():
        return rest
    return rest.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(rest.where("doc_id IS NULL"))


def oracle_sql(k: int = 2, percent: int = 80) -> str:
    """Components of all pairs, by DuckDB; for small tables."""
    gram = " || ' ' || ".join(f"w[i+{j}]" if j else "w[i]" for j in range(k))
    return f"""
WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, {gram} AS g FROM t, unnest(range(1, greatest(len(w) - {k - 2}, 1))) AS u(i) WHERE len(w) >= {k}
      UNION SELECT doc_id, '=' || array_to_string(w, ' ') FROM t WHERE len(w) BETWEEN 1 AND {k - 1}),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id < y.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= {percent} * (na.n + nb.n - c)),
l AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS doc_id, a AS top FROM l UNION SELECT l.b, r.top FROM r JOIN l ON l.a = r.doc_id AND r.top < l.b),
m AS (SELECT doc_id, min(top) AS top FROM r GROUP BY doc_id)
SELECT t.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.top, t.doc_id) AS component_id, coalesce(m.top, t.doc_id) = t.doc_id AS kept
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""
