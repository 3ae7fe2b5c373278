"""Each row's nearest earlier row of its part, by cosine, exact above a threshold.

Rows of a part are sorted by the pivot they are nearest to and the angle to it,
and cut into blocks of at most ``BLOCK`` rows, each with a centre and the widest
angle to it. Two blocks hold a pair above the threshold only if the angle of
their centres is at most the threshold's plus both widths (the triangle
inequality on the sphere); only such pairs of blocks meet, and a pair of blocks
is one matrix product. A row leaves one candidate for each pair of blocks. So no
pair of rows is ever shuffled, and a part of any size is many bounded tasks.
How much is left out depends on the vectors: those without clusters lie at right
angles to each other, and there every two blocks meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.retrieval import ORDER
from palimpsest.sources.shared import folder, stored

#: Rows of a block, pivots, block pairs of a task that looks for meeting blocks (its square), slack of an angle for rounding.
BLOCK, PIVOTS, MEET, SLACK = 2_048, 64, 512, 1e-6
BLOCKS = "part string, dim int, block long, centre array<double>, width double, ids binary, units binary"


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _block(part: str, dim: int, block: int, ids: np.ndarray, units: np.ndarray) -> tuple:
    by_id = np.argsort(ids, kind="stable")
    ids, units = ids[by_id], units[by_id]
    mean = units.sum(axis=0)
    size = np.linalg.norm(mean)
    centre = mean / size if size > 1e-9 else units[0]
    width = float(np.arccos(np.clip(units @ centre, -1, 1)).max())
    return part, dim, block, centre.tolist(), width, ids.tobytes(), units.tobytes()


def _blocks(rows: DataFrame) -> DataFrame:
    """Blocks of rows (part, id, dim, vec), from ranges of (part, dim, pivot, angle)."""
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("vec").collect()  # bounded
    most = BLOCK
    pivots = [np.array(r.vec) / np.linalg.norm(r.vec) for r in sample]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cell, angle = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                v = _matrix(batch.column("vec").take(pa.array(at)), d)
                p = np.array([x for x in pivots if len(x) == d])
                if len(p):
                    cos = (v @ p.T) / np.linalg.norm(v, axis=1)[:, None]
                    cell[at] = cos.argmax(axis=1)
                    angle[at] = np.arccos(np.clip(cos.max(axis=1), -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], [*batch.schema.names, "cell", "angle"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, seq, key, ids, units = TaskContext.get().partitionId() << 32, 0, None, [], []

        def out() -> pa.RecordBatch:
            nonlocal seq, ids, units
            row = _block(*key[:2], first + seq, np.concatenate(ids), np.concatenate(units))
            seq, ids, units = seq + 1, [], []
            return pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))], schema=schema)

        names = ["part", "dim", "block", "centre", "width", "ids", "units"]
        schema = pa.schema([("part", pa.string()), ("dim", pa.int32()), ("block", pa.int64()), ("centre", pa.list_(pa.float64())), ("width", pa.float64()), ("ids", pa.binary()), ("units", pa.binary())])
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("part", "dim", "cell")), strict=True))
            i = 0
            while i < len(keys):
                if ids and (keys[i] != key or sum(map(len, ids)) == most):
                    yield out()
                room = most - sum(map(len, ids))
                key, j = keys[i], i
                while j < len(keys) and keys[j] == key and j - i < room:
                    j += 1
                v = _matrix(batch.column("vec").slice(i, j - i), key[1])
                ids.append(batch.column("id").slice(i, j - i).to_numpy())
                units.append(v / np.linalg.norm(v, axis=1)[:, None])
                i = j
        if ids:
            yield out()

    placed = rows.select("part", "id", "dim", "vec").mapInArrow(near, "part string, id long, dim int, vec array<double>, cell int, angle double")
    ranged = placed.repartitionByRange("part", "dim", "cell", "angle", "id").sortWithinPartitions("part", "dim", "cell", "angle", "id")
    return stored(ranged.mapInArrow(cut, BLOCKS), f"{folder(rows.sparkSession)}/blocks")


def _meeting(blocks: DataFrame, angle: float) -> DataFrame:
    """(a, b): blocks of a part that may hold a pair within the angle, a <= b; a part of many blocks is dealt over many tasks."""
    s = blocks.select("part", "dim", "block", "centre", "width")
    salts = s.groupBy("part", "dim").agg(F.ceil(F.count("*") / MEET).cast("int").alias("salts"))
    s = s.join(salts, ["part", "dim"])
    left = s.select("part", "dim", F.col("block").alias("a"), F.col("centre").alias("ca"), F.col("width").alias("wa"), F.pmod(F.xxhash64("block"), "salts").cast("int").alias("salt"))
    right = s.select("part", "dim", F.col("block").alias("b"), F.col("centre").alias("cb"), F.col("width").alias("wb"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    dot = F.aggregate(F.zip_with("ca", "cb", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))
    return left.join(right, ["part", "dim", "salt"]).where((F.col("a") <= F.col("b")) & (apart <= F.col("wa") + F.col("wb") + F.lit(angle + SLACK))).select("a", "b")


def _best(ids: np.ndarray, others: np.ndarray, cos: np.ndarray, least: float) -> list[np.ndarray]:
    """Of each row the best earlier column, the smallest id on ties (others rise), if near enough."""
    cos = np.where(others[None, :] < ids[:, None], np.round(cos, ORDER), -2.0)
    k = cos.argmax(axis=1)
    top = cos[np.arange(len(ids)), k]
    good = top >= least
    return [ids[good], others[k[good]], top[good]]


def nearest_earlier(rows: DataFrame, threshold: float, part: str = "part", key: str = "id", vec: str = "vec") -> DataFrame:
    """(id, into_id, cos): each row's nearest row of its part with a smaller id, where the cosine is at least threshold; ties go to the smallest id.

    Cosines are compared at twelve places. Rows without part, id or vector, of length zero or with a component that isn't
    finite take no part; vectors of different dimensions are never near; no rows give no rows. threshold lies above -1.
    """
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists("vec", lambda x: x != 0)
    kept = rows.select(F.col(part).cast("string").alias("part"), F.col(key).cast("long").alias("id"), F.size(vec).alias("dim"), F.col(vec).cast("array<double>").alias("vec"))
    kept = kept.where("part IS NOT NULL AND id IS NOT NULL AND vec IS NOT NULL").where(fine)
    blocks = _blocks(kept)
    pairs = _meeting(blocks, math.acos(min(1.0, threshold)))
    side = lambda n: blocks.select(F.col("block").alias(n), "dim", F.col("ids").alias(f"ids_{n}"), F.col("units").alias(f"units_{n}"))
    both = pairs.join(side("a"), "a").join(side("b").drop("dim"), "b")

    def compare(table: pa.Table) -> pa.Table:
        found = []
        for i in range(table.num_rows):
            a, b, dim, ia, ua, ib, ub = (table.column(c)[i].as_py() for c in ("a", "b", "dim", "ids_a", "units_a", "ids_b", "units_b"))
            ia, ib = np.frombuffer(ia, np.int64), np.frombuffer(ib, np.int64)
            cos = np.frombuffer(ua).reshape(-1, dim) @ np.frombuffer(ub).reshape(-1, dim).T
            found.append(_best(ia, ib, cos, threshold))
            if a != b:
                found.append(_best(ib, ia, cos.T, threshold))
        return pa.table([np.concatenate(x) for x in zip(*found, strict=True)], ["id", "into_id", "cos"])

    near = both.groupBy("a", "b").applyInArrow(compare, "id long, into_id long, cos double")
    best = near.groupBy("id").agg(F.max(F.struct("cos", (-F.col("into_id")).alias("i"))).alias("m"))
    return best.select("id", (-F.col("m.i")).alias("into_id"), F.col("m.cos").alias("cos"))
