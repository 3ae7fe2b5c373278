"""Hard negatives by exact dual-tree search.

Vectors become whole numbers, so scores are exact inner products. A tree of
splits is fitted on a bounded sample; every row, anchor or candidate, is routed through it to a
cell, and each cell's rows are cut by label into blocks (candidates) and groups
(anchors) of bounded size. Every node of both trees has a center and a radius, hence two
nodes have an interval of inner products. Starting from the roots, pairs of nodes
are expanded level by level by joins on their parents; a pair whose interval misses
all windows of its anchors goes, and whole groups of anchors with it. Blocks and groups that remain meet
in tasks of bounded size, which go on in the same manner below, in trees of their own,
and score pairs of leaves exactly.

The search runs three times: inside the anchors' own cells, for a floor of each
anchor's positives; for the positives above the floor; and for negatives inside the window
``lowest .. positive_score`` of every positive.

Of rows with equal vectors and labels only the smallest ids can be returned, so the
others are no candidates; this is exact, and a vector that a third of all rows share takes few places.

Defined results: rows with a null id, label or vector, or a null or non-finite component take no part;
repeated rows count once; a row of the anchor's id is none of its positives; rows of
one id and different contents are anchors each; shorter vectors end in zeros; ties go to the smaller id; an anchor
without positives, or a positive without negatives, has no rows. Scores have to fit 64 bits. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from palimpsest.llm.runs import runs
from palimpsest.llm.scratch import Scratch

SAMPLE = 4096  # rows that the splits are fitted on; all rows are routed and searched
BLOCK = 8192  # candidates
GROUP = 256  # anchors
GROUPS = 64  # in a task with one block
DEPTH = 10  # of the fitted tree
STEP = 3  # levels that a round expands
LEAF = 256
FAR = 1 << 62
_FOUND = "key long, j int, id long, score long"


# --- splits ---------------------------------------------------------------------------


def fit_splits(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions and thresholds of a complete binary tree, each between two far rows, at the median."""
    w, t = np.zeros((2**depth - 1, x.shape[1])), np.zeros(2**depth - 1)
    where = np.zeros(len(x), dtype=np.int64)
    for node in range(2**depth - 1):
        own = x[where == node]
        if len(own) > 1:
            a = own[np.square(own - own.mean(axis=0)).sum(axis=1).argmax()]
            b = own[np.square(own - a).sum(axis=1).argmax()]
            w[node], t[node] = b - a, np.median(own @ (b - a))
        at = where == node
        where[at] = 2 * node + 1 + (x[at] @ w[node] > t[node])
    return w, t


def route(x: np.ndarray, w: np.ndarray, t: np.ndarray) -> np.ndarray:
    node = np.zeros(len(x), dtype=np.int64)
    while len(t) and node[:1] < len(t):
        node = 2 * node + 1 + ((x * w[node]).sum(axis=1) > t[node])
    return node - len(t)


def matrix(column: pa.ChunkedArray | pa.Array, exact: bool = False) -> np.ndarray:
    """Rows of a list column; as whole numbers of any size where products might not fit a double."""
    flat = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False)
    values = values.reshape(len(flat), -1) if len(values) else np.zeros((len(flat), 1), dtype=np.int64)
    if exact and values.shape[1] * float(np.abs(values.astype(np.float64)).max(initial=0)) ** 2 >= 2**53:
        return values.astype(object)
    return values.astype(np.float64)


def _ball(x: np.ndarray) -> tuple[np.ndarray, float]:
    x = x.astype(np.float64)
    c = x.mean(axis=0)
    return c, math.sqrt(np.square(x - c).sum(axis=1).max())


# --- search in a task -----------------------------------------------------------------


class Ball:
    """A node over some rows of a matrix, halved until a leaf is left."""

    def __init__(self, x: np.ndarray, rows: np.ndarray, leaf: int):
        self.rows, self.children = rows, []
        own = x[rows].astype(np.float64)
        self.center, self.radius = _ball(own)
        self.norm = float(np.linalg.norm(self.center))
        if len(rows) > leaf and self.radius > 0:
            w, t = fit_splits(own, 1)
            right = route(own, w, t) == 1
            if right.any() and not right.all():
                self.children = [Ball(x, rows[~right], leaf), Ball(x, rows[right], leaf)]


def interval(a: Ball, b: Ball) -> tuple[float, float]:
    """Bounds of all inner products of two nodes' rows, widened by the rounding of sums."""
    middle = float(a.center @ b.center)
    spread = a.norm * b.radius + b.norm * a.radius + a.radius * b.radius
    spread += 1 + 1e-9 * (abs(middle) + spread)
    return middle - spread, middle + spread


class Search:
    """The k best rows of one block for every window of a group's anchors."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, a: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        self.x, self.ids, self.a, self.own, self.low, self.high, self.k = x, ids, a, own, low.copy(), high, k
        self.scores = np.full((*low.shape, k), -FAR, dtype=np.int64)
        self.found = np.full((*low.shape, k), FAR, dtype=np.int64)
        self.scored = 0

    def visit(self, a: Ball, b: Ball) -> None:
        lo, hi = interval(a, b)
        if hi < self.low[a.rows].min() or lo > self.high[a.rows].max():
            return
        if not a.children and not b.children:
            self._leaves(a.rows, b.rows)
        elif b.children and (not a.children or len(b.rows) >= len(a.rows)):
            for child in sorted(b.children, key=lambda n: -float(a.center @ n.center)):
                self.visit(a, child)
        else:
            for child in a.children:
                self.visit(child, b)

    def _leaves(self, rows: np.ndarray, others: np.ndarray) -> None:
        s = (self.a[rows] @ self.x[others].T).astype(np.int64)
        self.scored += s.size
        ids = self.ids[others]
        fits = ids[None, :] != self.own[rows, None]
        for j in range(self.low.shape[1]):
            at, of = np.nonzero((s >= self.low[rows, j, None]) & (s <= self.high[rows, j, None]) & fits)
            if not len(at):
                continue
            here = np.unique(at)
            row = np.concatenate([np.repeat(here, self.k), at])
            score = np.concatenate([self.scores[rows[here], j].ravel(), s[at, of]])
            found = np.concatenate([self.found[rows[here], j].ravel(), ids[of]])
            order = np.lexsort((found, -score, row))
            row, score, found = row[order], score[order], found[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            best = rank < self.k
            self.scores[rows[row[best]], j, rank[best]] = score[best]
            self.found[rows[row[best]], j, rank[best]] = found[best]
            self.low[rows, j] = np.maximum(self.low[rows, j], self.scores[rows, j, self.k - 1])


def _searched(k: int) -> Callable:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, unit in runs(batches, ["block", "slice"]):
            kind = unit["kind"].to_numpy()
            n = int((kind == 0).sum())  # the block's rows come first
            every = matrix(unit["q"], exact=True)
            x, ids = every[:n], unit["id"].to_numpy()
            tree = Ball(x, np.arange(n), LEAF)
            groups = unit["grp"].to_pylist()[n:]
            cuts = [0, *[i for i in range(1, len(groups)) if groups[i] != groups[i - 1]], len(groups)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                rows = unit.slice(n + i, j - i)
                low, high = rows["low"].to_pylist(), rows["high"].to_pylist()
                wide = max(map(len, low))
                low = np.array([[*r, *[FAR] * (wide - len(r))] for r in low], dtype=np.int64)
                high = np.array([[*r, *[-FAR] * (wide - len(r))] for r in high], dtype=np.int64)
                a, keys = every[n + i : n + j], rows["key"].to_numpy()
                found = Search(x, ids[:n], a, ids[n + i : n + j], low, high, k)
                found.visit(Ball(a, np.arange(len(a)), LEAF // 4), tree)
                at, window, rank = np.nonzero(found.scores > -FAR)
                yield pa.RecordBatch.from_pydict({"key": keys[at], "j": window.astype(np.int32), "id": found.found[at, window, rank], "score": found.scores[at, window, rank]})

    return search


# --- nodes and pairs ------------------------------------------------------------------


def _summaries(rows: DataFrame, name: str, extra: list[str]) -> DataFrame:
    """One row for each block or group: its size, center, radius and widest window."""

    def ball(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in runs(batches, [name]):
            c, r = _ball(matrix(t["q"]))
            low = min((min(x) for x in t["low"].to_pylist() if x), default=FAR) if "low" in extra else 0
            high = max((max(x) for x in t["high"].to_pylist() if x), default=-FAR) if "high" in extra else 0
            yield pa.RecordBatch.from_pydict({"label": t["label"][:1].combine_chunks(), "cell": t["cell"][:1].combine_chunks(), name: t[name][:1].combine_chunks(), "n": [len(t)], "center": [c], "radius": [r], "low": [low], "high": [high]})

    label = rows.schema["label"].dataType.simpleString()
    dealt = rows.select("label", "cell", name, "q", *extra).repartition(name).sortWithinPartitions(name)
    return dealt.mapInArrow(ball, f"label {label}, cell long, {name} string, n long, center array<double>, radius double, low long, high long")


def _merged(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes that hold all nodes of equal keys."""

    def ball(t: pd.DataFrame) -> pd.DataFrame:
        centers, n = np.stack(t["center"].to_list()), t["n"].to_numpy()
        c = (centers * n[:, None]).sum(axis=0) / n.sum()
        r = float((np.sqrt(np.square(centers - c).sum(axis=1)) + t["radius"].to_numpy()).max())
        return pd.DataFrame([{**{k: t[k].iloc[0] for k in keys}, "n": n.sum(), "center": c, "radius": r, "low": t["low"].min(), "high": t["high"].max()}])

    types = ", ".join(f"{k} {nodes.schema[k].dataType.simpleString()}" for k in keys)
    return nodes.groupBy(*keys).applyInPandas(ball, f"{types}, n long, center array<double>, radius double, low long, high long")


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _meet(pairs: DataFrame) -> DataFrame:
    """Pairs whose interval of inner products touches a window."""
    middle, na, nb = _dot("a.center", "b.center"), F.sqrt(_dot("a.center", "a.center")), F.sqrt(_dot("b.center", "b.center"))
    spread = na * F.col("b.radius") + nb * F.col("a.radius") + F.col("a.radius") * F.col("b.radius")
    spread = spread + 1 + 1e-9 * (F.abs(middle) + spread)
    return pairs.where((middle + spread >= F.col("a.low")) & (middle - spread <= F.col("a.high")))


def pairs_of(groups: DataFrame, blocks: DataFrame, depth: int, same: bool, scratch: Scratch, name: str) -> DataFrame:
    """``(grp, block)`` left of the product of both trees: of equal labels, or of different ones."""
    keys = ["label", "node"] if same else ["node"]
    shallow = list(range(0, depth + 1, STEP))
    pairs, before = None, 0
    for level in shallow:
        node = F.shiftright("cell", depth - level).alias("node")
        a, b = (_merged(side.withColumn("node", node), keys).alias(s) for side, s in ((groups, "a"), (blocks, "b")))
        if pairs is None:  # the roots: one pair, or one for each label
            on = F.col("a.node") == F.col("b.node")
            on = on & (F.col("a.label") == F.col("b.label")) if same else on
            met = _meet(a.join(b, on))
        else:
            p = pairs.alias("p")
            up = level - before
            on_a, on_b = F.col("p.an") == F.shiftright("a.node", up), F.col("p.bn") == F.shiftright("b.node", up)
            if same:
                on_a, on_b = on_a & (F.col("p.label") == F.col("a.label")), on_b & (F.col("p.label") == F.col("b.label"))
            met = _meet(p.join(a, on_a).join(b, on_b))
        pairs = met.select(*([F.col("a.label").alias("label")] if same else []), F.col("a.node").alias("an"), F.col("b.node").alias("bn"))
        before = level
    rest = depth - before
    p, a, b = pairs.alias("p"), groups.alias("a"), blocks.alias("b")
    on_a, on_b = F.col("p.an") == F.shiftright("a.cell", rest), F.col("p.bn") == F.shiftright("b.cell", rest)
    if same:
        on_a, on_b = on_a & (F.col("p.label") == F.col("a.label")), on_b & (F.col("p.label") == F.col("b.label"))
    met = p.join(a, on_a).join(b, on_b if same else on_b & (F.col("a.label") != F.col("b.label")))
    return scratch.save(_meet(met).select("grp", "block"), name)


def _search(anchors: DataFrame, candidates: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """``(key, j, id, score, rank)``: the k best candidates of each window ``low[j] .. high[j]`` over all pairs."""
    order = W.partitionBy("block").orderBy("grp")
    units = pairs.withColumn("slice", F.floor((F.row_number().over(order) - 1) / GROUPS).cast("long"))
    void = [F.lit(None).cast(t).alias(c) for c, t in (("key", "long"), ("grp", "string"), ("low", "array<long>"), ("high", "array<long>"))]
    x = candidates.join(units.select("block", "slice").distinct(), "block").select("block", "slice", F.lit(0).alias("kind"), *void, "id", "q")
    a = anchors.join(units, "grp").select("block", "slice", F.lit(1).alias("kind"), "key", "grp", "low", "high", "id", "q")
    dealt = x.unionByName(a).repartition("block", "slice").sortWithinPartitions("block", "slice", "kind", "grp", "id")
    found = dealt.mapInArrow(_searched(k), _FOUND)
    rank = F.row_number().over(W.partitionBy("key", "j").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _routed(rows: DataFrame, w: np.ndarray, t: np.ndarray) -> DataFrame:
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = route(matrix(b.column(b.schema.get_field_index("q"))), w, t)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.int64())], [*b.schema.names, "cell"])

    return rows.mapInArrow(cells, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, cell long")


def _cut(rows: DataFrame, size: int, name: str) -> DataFrame:
    """rows with the name of a part of their label and cell, of about ``size`` rows."""
    parts = rows.groupBy("label", "cell").agg(F.ceil(F.count("*") / size).alias("parts"))
    part = F.expr("pmod(xxhash64(id, q), parts)")
    return rows.join(parts, ["label", "cell"]).withColumn(name, F.concat_ws("/", F.col("label").cast("string"), "cell", part)).drop("parts")


# --- the operator ---------------------------------------------------------------------


def whole_numbers(rows: DataFrame, scale: float = 256.0, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``(id, label, q)`` of the rows that take part."""
    v = F.col(vector)
    bad = F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
    good = rows.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & ~bad)
    return good.select(F.col(id_col).cast("long").alias("id"), F.col(label).alias("label"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("q"))


def mine(rows: DataFrame, anchor: Column, lowest: str = "(4 * score + 4) div 5", positives: int = 5, negatives: int = 5, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """Hard negatives of ``(id, label, q)``: for each positive of an anchor, the best rows of other labels that score ``lowest .. score``."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "negatives")
    wide = rows.agg(F.max(F.size("q"))).first()[0] or 1
    rows = rows.withColumn("q", F.concat("q", F.array_repeat(F.lit(0).cast("long"), F.lit(wide) - F.size("q")))).dropDuplicates(["id", "label", "q"])
    rows = scratch.save(rows.withColumn("key", F.xxhash64("id", "label", "q")), "rows")
    n, labels = rows.agg(F.count("*"), F.approx_count_distinct("label")).first()
    depth = min(DEPTH, max(0, math.ceil(math.log2(max(1, n / max(1, labels) / block)))))
    sample = rows.select("q", F.xxhash64("id").alias("h")).orderBy("h").limit(SAMPLE).toArrow()  # bounded
    w, t = fit_splits(matrix(sample["q"]), depth)
    few = F.row_number().over(W.partitionBy("label", "q").orderBy("id")) <= max(positives + 1, negatives)
    candidates = scratch.save(_cut(_routed(rows.withColumn("few", few).where("few").drop("few"), w, t), block, "block"), "candidates")
    anchors = scratch.save(_cut(_routed(rows.where(anchor), w, t), group, "grp"), "anchors")
    blocks = scratch.save(_summaries(candidates, "block", []), "blocks")

    def windowed(found: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        own = scratch.save(anchors.join(found, "key"), name)
        return own, scratch.save(_summaries(own, "grp", ["low", "high"]), f"{name}-groups")

    home = blocks.groupBy("label", "cell").agg(F.min("block").alias("block")).join(anchors.select("label", "cell", "grp").distinct(), ["label", "cell"]).select("grp", "block")
    everything = anchors.withColumn("low", F.array(F.lit(-FAR))).withColumn("high", F.array(F.lit(FAR)))
    near = _search(everything, candidates, home, positives)
    floor = near.where(F.col("rank") == positives).select("key", F.array("score").alias("low"))
    floor = anchors.select("key").join(floor, "key", "left").select("key", F.coalesce("low", F.array(F.lit(-FAR))).alias("low"), F.array(F.lit(FAR)).alias("high"))
    own, groups = windowed(floor, "floors")
    found = scratch.save(_search(own, candidates, pairs_of(groups, blocks, depth, True, scratch, "positive-pairs"), positives), "positives")
    found = found.select("key", F.col("rank").alias("p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.expr(lowest).cast("long").alias("lo"))
    open_ = found.where("lo <= positive_score").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("p", "lo", "positive_score"))).alias("s"))  # one for each positive
    own, groups = windowed(open_.select("key", F.col("s.lo").alias("low"), F.col("s.positive_score").alias("high"), F.col("s.p").alias("p")), "windows")
    hard = _search(own.drop("p"), candidates, pairs_of(groups, blocks, depth, False, scratch, "negative-pairs"), negatives)
    hard = hard.join(own.select("key", F.col("id").alias("anchor_id"), F.posexplode("p").alias("j", "p")), ["key", "j"]).join(found, ["key", "p"])
    return hard.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def relabelled(rows: DataFrame) -> DataFrame:
    """The query's rows: ids divisible by seven change their label."""
    return rows.withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"))


def digest(embeddings: DataFrame) -> DataFrame:
    return mine(whole_numbers(relabelled(embeddings.select("vec_id", "embedding", "label"))), F.col("id") % 100 == 0)


def oracle_sql() -> str:
    return """WITH rows AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (SELECT a.id AS anchor_id, a.label = b.label AS alike, b.id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
        FROM rows a JOIN rows b ON a.id % 100 = 0 AND a.id <> b.id),
    positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE alike
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scored USING (anchor_id) WHERE NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
    QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 5"""
