"""A Merkle manifest of a dataset: one tree of arity three for each source, and one over the sources.

Leaves are digests of whole rows, made by SQL functions. Rows get their place
inside a source from a range sort and the counts of the ranges before, so a hot
source spreads over many tasks. A source is cut into aligned blocks of 3**9
leaves. Going up, each block yields one node, and blocks of blocks follow until
one node is left. Going down, each block is traversed in fractal manner: at
every stratum of three levels a task holds the existing subtree, which covers the
current leaf, and the desired one, which grows by one leaf a step and takes its
place at the boundary; so authentication paths come out in order, from stacks and a
few dozens of nodes. A block's path is followed by that of its block above.

A path is text: for each level, the run's digests before the node, ``:``, those
after it; levels are parted by ``/``.

Defined results: a null field is ``-``; a null source is a tree of its own, the
first; null ids come first and are never tampered with; rows of equal id go by
their leaf's digest; repeated rows are leaves each; a lone leaf is its own subroot, a
lone subroot the root, and an empty proof is the digest of no bytes; an empty table
has no root and gives no rows. Other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from palimpsest.llm.runs import runs
from palimpsest.llm.scratch import Scratch

ARITY = 3
LEVELS = 9  # of a block: 19,683 leaves, two megabytes of digests
STRATUM = 3  # levels of a stacked subtree
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODES = "tree string, pos long, size long, digest string"
_PATHS = "tree string, pos long, path string, subroot string, root string"


def node(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def height(n: int, arity: int = ARITY) -> int:
    """Levels until n nodes have become one."""
    h = 0
    while n > 1:
        n, h = -(-n // arity), h + 1
    return h


def leaf(fields: list[Column]) -> Column:
    """Digest of a row: every field with its length, nulls told apart."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def is_tampered(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.lit(False))


# --- traversal of one block -----------------------------------------------------------


class Growing:
    """A subtree that takes leaves one by one and keeps the nodes of its own levels only."""

    def __init__(self, low: int, high: int):
        self.low, self.high = low, high
        self.stacks: list[list[str]] = [[] for _ in range(high)]
        self.kept: list[list[str]] = [[] for _ in range(high - low)]

    def _put(self, level: int, digest: str) -> None:
        while level < self.high:
            if level >= self.low:
                self.kept[level - self.low].append(digest)
            stack = self.stacks[level]
            stack.append(digest)
            if len(stack) < ARITY:
                return
            digest = node(stack)
            stack.clear()
            level += 1

    def add(self, digest: str) -> None:
        self._put(0, digest)

    def close(self) -> list[list[str]]:
        """The nodes by level, once no leaf is left for the runs begun."""
        for level, stack in enumerate(self.stacks):
            if stack:
                digest = node(stack)
                stack.clear()
                self._put(level + 1, digest)
        return self.kept


def fractal_paths(leaves: list[str], levels: int) -> Iterator[str]:
    """The path of each leaf in turn, over ``levels`` levels of the block's tree."""
    strata = [(low, min(low + STRATUM, levels)) for low in range(0, levels, STRATUM)]
    existing: list[list[list[str]]] = []
    desired: list[Growing] = []
    for low, high in strata:
        first = Growing(low, high)
        for digest in leaves[: ARITY**high]:
            first.add(digest)
        existing.append(first.close())
        desired.append(Growing(low, high))
    for i in range(len(leaves)):
        path = []
        for s, (low, high) in enumerate(strata):
            span = ARITY**high
            if i and i % span == 0:
                existing[s], desired[s] = desired[s].close(), Growing(low, high)
            inside = i % span
            for level in range(low, high):
                at = inside // ARITY**level
                run = at - at % ARITY
                nodes = existing[s][level - low]
                path.append("".join(nodes[run:at]) + ":" + "".join(nodes[at + 1 : run + ARITY]))
            if i + span < len(leaves):
                desired[s].add(leaves[i + span])
        yield "/".join(path)


def fold(digest: str, path: str) -> str:
    """The root that a leaf and its path lead to."""
    for level in path.split("/") if path else ():
        before, _, after = level.partition(":")
        digest = node([before, digest, after])
    return digest


def proof_digest(path: str) -> str:
    return sha256(path.replace("/", "").replace(":", "").encode()).hexdigest()


# --- places and levels ----------------------------------------------------------------


def _placed(rows: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """rows with ``pos``, from 0 inside each tree, and the tree's ``size``."""
    mixed = rows.withColumn("mix", F.xxhash64(F.monotonically_increasing_id()))  # equal rows need not meet in one range
    ordered = mixed.repartitionByRange("tree", *order, "mix").sortWithinPartitions("tree", *order, "mix").drop("mix")
    saved = scratch.save(ordered.withColumn("at", F.monotonically_increasing_id()), name)
    saved = saved.withColumn("range", F.shiftright("at", 33))
    per = saved.groupBy("tree", "range").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    upto = W.partitionBy("tree").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    per = per.select("tree", "range", (F.coalesce(F.sum("n").over(upto), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(W.partitionBy("tree")).alias("size"))
    return saved.join(per, ["tree", "range"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "range", "shift")


def _dealt(nodes: DataFrame, levels: int) -> DataFrame:
    """Whole blocks in a task, in order."""
    cut = nodes.withColumn("block", F.when(F.col("pos") < 0, F.col("block")).otherwise(F.expr(f"pos div {ARITY**levels}L")) if "block" in nodes.columns else F.expr(f"pos div {ARITY**levels}L"))
    return cut.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _climb(levels: int) -> Callable:
    """One node for each block."""

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (tree, block), rows in runs(batches, ["tree", "block"]):
            size, digests = rows["size"][0].as_py(), rows["digest"].to_pylist()
            for _ in range(min(levels, height(size))):
                digests = [node(digests[i : i + ARITY]) for i in range(0, len(digests), ARITY)]
            out.append((tree, block, -(-size // ARITY**levels), digests[0]))
            if len(out) >= 4096:
                yield _batch(out, ["tree", "pos", "size", "digest"])
                out = []
        if out:
            yield _batch(out, ["tree", "pos", "size", "digest"])

    return up


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))


def _walked(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[tuple[dict, list[dict], Iterator[str]]]:
    """(row of the block above, the block's rows, their paths in the block)."""
    for _, rows in runs(batches, ["tree", "block"]):
        above, *own = rows.to_pylist()
        digests = [r["digest"] for r in own]
        yield above, own, fractal_paths(digests, min(levels, height(own[0]["size"])))


def _descend(levels: int) -> Callable:
    """Paths up to the root for the nodes of one round."""

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for above, own, paths in _walked(batches, levels):
            for r, path in zip(own, paths, strict=True):
                out.append((r["tree"], r["pos"], "/".join(filter(None, (path, above["path"]))), above["subroot"], above["root"]))
                if len(out) >= 4096:
                    yield _batch(out, ["tree", "pos", "path", "subroot", "root"])
                    out = []
        if out:
            yield _batch(out, ["tree", "pos", "path", "subroot", "root"])

    return down


def _with_above(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """nodes and, ahead of each block, the path of the node that it became."""
    heads = above.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "path", "subroot", "root")
    return nodes.withColumn("block", F.lit(None).cast("long")).unionByName(heads, allowMissingColumns=True)


def _rounds(nodes: DataFrame, scratch: Scratch, name: str, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """(the nodes of each round from the leaves on, one node for each tree)."""
    size = nodes.agg(F.max("size")).first()[0] or 0
    steps = [nodes]
    while size > 1:
        nodes = scratch.save(_dealt(nodes.select("tree", "pos", "size", "digest"), levels).mapInArrow(_climb(levels), _NODES), f"{name}-{len(steps)}")
        steps.append(nodes)
        size = -(-size // ARITY**levels)
    return steps[:-1] if len(steps) > 1 else steps, nodes


def _paths(steps: list[DataFrame], above: DataFrame, scratch: Scratch, name: str, levels: int) -> DataFrame:
    for k, nodes in reversed(list(enumerate(steps))):
        dealt = _dealt(_with_above(nodes.select("tree", "pos", "size", "digest"), above), levels)
        above = scratch.save(dealt.mapInArrow(_descend(levels), _PATHS), f"{name}-paths-{k}")
    return above


def leaves(docs: DataFrame) -> DataFrame:
    """``(tree, doc_id, digest, changed)``: changed is the leaf after tampering, where a row is tampered with."""
    c = [F.col(f) for f in FIELDS]
    text = F.when(is_tampered(c[0]), F.translate(c[4], "\n", "")).otherwise(c[4])
    tree = F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit("0"))  # a null source sorts first
    return docs.select(tree.alias("tree"), "doc_id", leaf(c).alias("digest"), F.when(is_tampered(c[0]), leaf([*c[:4], text])).alias("changed"))


def manifest(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``(tree, doc_id, leaf, subroot, root, path, changed)`` of ``leaves()`` or any rows of that shape."""
    return _manifest(rows, levels, _full(levels), "tree string, doc_id long, leaf string, subroot string, root string, path string, changed string")


def digests(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Root, proof digest and verification of every row of documents; long paths never leave the tasks."""
    out = _manifest(leaves(docs), levels, _proved(levels), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _manifest(rows: DataFrame, levels: int, last: Callable, schema: str) -> DataFrame:
    scratch = Scratch(rows.sparkSession, "merkle")
    placed = scratch.save(_placed(rows, ["doc_id", "digest"], scratch, "sorted"), "leaves")
    scratch.drop("sorted")
    steps, tops = _rounds(placed, scratch, "nodes", levels)
    sources = scratch.save(_placed(tops.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest"), ["source"], scratch, "sorted-roots"), "roots")
    up, roots = _rounds(sources, scratch, "root", levels)
    root = (roots.select("digest").first() or [""])[0]  # one row
    above = rows.sparkSession.createDataFrame([("", 0, "", "", root)], _PATHS)
    tree_paths = _paths(up, above, scratch, "root", levels) if root else above.limit(0)
    heads = sources.drop("tree").join(tree_paths.select("pos", "path", "root"), "pos")
    heads = heads.select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root")
    above = _paths(steps[1:], heads, scratch, "nodes", levels)
    return _dealt(_with_above(placed, above), levels).mapInArrow(last, schema)


def _full(levels: int) -> Callable:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for above, own, paths in _walked(batches, levels):
            out = [(r["tree"], r["doc_id"], r["digest"], above["subroot"], above["root"], "/".join(filter(None, (p, above["path"]))), r["changed"]) for r, p in zip(own, paths, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.string(), pa.int64(), *[pa.string()] * 5], strict=True)], ["tree", "doc_id", "leaf", "subroot", "root", "path", "changed"])

    return emit


def _proved(levels: int) -> Callable:
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for above, own, paths in _walked(batches, levels):
            for r, p in zip(own, paths, strict=True):
                path = "/".join(filter(None, (p, above["path"])))
                out.append((r["doc_id"], r["digest"], above["subroot"], above["root"], proof_digest(path), fold(r["changed"] or r["digest"], path)))
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), *[pa.string()] * 5], strict=True)], names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), *[pa.string()] * 5], strict=True)], names)

    return emit


# --- SQL ------------------------------------------------------------------------------


def oracle_sql() -> str:
    """The same rows by recursive levels in DuckDB."""

    def row(text: str) -> str:
        fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
        return "sha256(" + " || ".join(f"coalesce(CAST(strlen({f}) AS VARCHAR) || ':' || {f}, '-')" for f in fields) + ")"

    crc = """xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten([[ascii(c)::UBIGINT, 0, 0, 0, 0, 0, 0, 0] for c in string_split(CAST(doc_id AS VARCHAR), '')])),
        lambda a, v: xor(xor(a, v) >> 1, 3988292384::UBIGINT * (xor(a, v) & 1::UBIGINT))), 4294967295::UBIGINT)"""

    def climb(name: str, base: str) -> str:
        return f"""{name} AS ({base} UNION ALL
        SELECT l + 1, tree, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(d, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY l, tree, pos // 3)"""

    return f"""WITH RECURSIVE
    leaves AS (SELECT doc_id, coalesce('1' || source, '0') AS tree, {row("text")} AS leaf,
        CASE WHEN {crc} % 2 = 0 THEN {row("replace(text, chr(10), '')")} ELSE {row("text")} END AS changed FROM documents),
    placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
    {climb("lower", "SELECT 0 AS l, tree, pos, n, leaf AS d FROM placed")},
    subroots AS (SELECT tree, d FROM lower WHERE n = 1),
    {climb("upper", "SELECT 0 AS l, '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, d FROM subroots")},
    ranked AS (SELECT tree, d AS subroot, row_number() OVER (ORDER BY tree) - 1 AS at FROM subroots),
    low AS (SELECT p.tree, p.pos AS leaf_pos, string_agg(s.d, '' ORDER BY s.l, s.pos) AS proof FROM placed p JOIN lower s ON s.tree = p.tree AND s.n > 1
        AND s.pos // 3 = p.pos // CAST(pow(3, s.l + 1) AS BIGINT) AND s.pos <> p.pos // CAST(pow(3, s.l) AS BIGINT) GROUP BY ALL),
    high AS (SELECT r.tree, string_agg(s.d, '' ORDER BY s.l, s.pos) AS proof FROM ranked r JOIN upper s ON s.n > 1
        AND s.pos // 3 = r.at // CAST(pow(3, s.l + 1) AS BIGINT) AND s.pos <> r.at // CAST(pow(3, s.l) AS BIGINT) GROUP BY ALL),
    folded AS (SELECT 0 AS l, tree, pos AS leaf_pos, pos, n, changed AS d FROM placed UNION ALL
        SELECT f.l + 1, f.tree, f.leaf_pos, f.pos // 3, (any_value(f.n) + 2) // 3, sha256(string_agg(CASE WHEN s.pos = f.pos THEN f.d ELSE s.d END, '' ORDER BY s.pos))
        FROM folded f JOIN lower s ON s.l = f.l AND s.tree = f.tree AND s.pos // 3 = f.pos // 3 WHERE f.n > 1 GROUP BY f.l, f.tree, f.leaf_pos, f.pos // 3),
    refolded AS (SELECT 0 AS l, f.tree, f.leaf_pos, r.at AS pos, (SELECT count(*) FROM subroots) AS n, f.d FROM folded f JOIN ranked r ON r.tree = f.tree WHERE f.n = 1 UNION ALL
        SELECT f.l + 1, f.tree, f.leaf_pos, f.pos // 3, (any_value(f.n) + 2) // 3, sha256(string_agg(CASE WHEN s.pos = f.pos THEN f.d ELSE s.d END, '' ORDER BY s.pos))
        FROM refolded f JOIN upper s ON s.l = f.l AND s.pos // 3 = f.pos // 3 WHERE f.n > 1 GROUP BY f.l, f.tree, f.leaf_pos, f.pos // 3)
    SELECT p.doc_id, p.leaf, r.subroot, u.d AS root, sha256(coalesce(low.proof, '') || coalesce(high.proof, '')) AS proof_sha256, f.d AS folded_root, f.d = u.d AS verified
    FROM placed p JOIN ranked r ON r.tree = p.tree JOIN upper u ON u.n = 1 JOIN refolded f ON f.tree = p.tree AND f.leaf_pos = p.pos AND f.n = 1
    LEFT JOIN low ON low.tree = p.tree AND low.leaf_pos = p.pos LEFT JOIN high ON high.tree = p.tree"""
