"""Hard negatives against plain loops, over trees of several levels, and what the trees prune."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import hard_negatives as H
from palimpsest.llm.scratch import Scratch

TYPES = "vec_id long, embedding array<float>, label int, score double, block string, key int"


def plain(rows):
    """(vec_id, embedding, label) -> the query's rows."""
    own = set()
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, label, q in own:
        if i % 100:
            continue
        scored = sorted((-dot(q, r), j, other) for j, other, r in own if j != i)
        for s, j, _ in [x for x in scored if x[2] == label][:5]:
            hard = [x for x in scored if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(i, j, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(hard)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, 0.5, "b", 1) for r in rows], TYPES).repartition(4)


def got(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(12, 8))
    v = [(centers[i % 12] + rng.normal(size=8) * 0.15).tolist() for i in range(900)]
    rows = [(i, v[i], i % 4) for i in range(900)]
    rows += [(2000 + i, [0.5] * 8, 1 + i % 2) for i in range(300)]  # one common vector, anchors among its rows
    rows += [(3000, None, 1), (3100, [0.1] * 8, None), (3200, [float("nan")] * 8, 1), (3300, [None] * 8, 1), (None, [0.1] * 8, 1), (3400, [float("inf")] * 8, 1)]
    rows += [(3500, [], 2), (3600, [0.25, 0.25], 3), (3700, [-0.2] * 8, 9)] + [(100, v[100], 0)] * 3
    return rows


@pytest.mark.parametrize("block,group", [(8192, 256), (16, 2), (5, 1)])
def test_equals_plain_loops(spark, rows, block, group, monkeypatch):
    monkeypatch.setattr(H, "GROUPS", 2)
    out = H.mine(H.whole_numbers(H.relabelled(table(spark, rows))), F.col("id") % 100 == 0, block=block, group=group)
    want = plain(rows)
    assert len(want) > 100 and got(out) == want


def test_whole_groups_are_pruned(spark):
    """Clusters far apart: most pairs of groups and blocks go by their intervals alone, and no link is lost."""
    rng = np.random.default_rng(8)
    rows = [(i, ((np.eye(8)[i % 8] * 4) + rng.normal(size=8) * 0.02).tolist(), i // 8 % 2) for i in range(3200)]
    docs = H.whole_numbers(H.relabelled(table(spark, rows)))
    kept = {}
    pairs_of = H.pairs_of

    def watch(groups, blocks, depth, same, scratch, name):
        out = pairs_of(groups, blocks, depth, same, scratch, name)
        kept[name] = (depth, out.count(), groups.count() * blocks.count())
        return out

    H.pairs_of = watch
    try:
        out = got(H.mine(docs, F.col("id") % 20 == 0, block=24, group=4))
    finally:
        H.pairs_of = pairs_of
    assert out and {a % 20 for a, *_ in out} == {0}
    for depth, left, product in kept.values():
        assert depth >= H.STEP + 1 and left < product / 3
    assert got(H.mine(docs, F.col("id") % 20 == 0)) == out


def test_leaves_are_pruned_in_a_block():
    rng = np.random.default_rng(2)
    x = np.floor(256 * (np.eye(4)[np.arange(4000) % 4] * 3 + rng.normal(size=(4000, 4)) * 0.05))
    found = H.Search(x, np.arange(4000), x[:8], np.arange(8), np.full((8, 1), -H.FAR), np.full((8, 1), H.FAR), 5)
    found.visit(H.Ball(x, np.arange(8), 2), H.Ball(x, np.arange(4000), 64))
    s = (x[:8] @ x.T).astype(int)
    s[np.arange(8), np.arange(8)] = -H.FAR
    assert (found.found[:, 0] == [sorted(range(4000), key=lambda j: (-r[j], j))[:5] for r in s]).all()
    assert found.scored < 8 * 4000 / 2


def test_large_numbers_stay_exact(spark):
    random.seed(4)
    rows = [(i, [float(np.float32(random.uniform(-4e5, 4e5))) for _ in range(4)], i % 3) for i in range(120)]
    assert got(H.digest(table(spark, rows))) == plain(rows)


def test_bounds_hold():
    rng = np.random.default_rng(9)
    for _ in range(200):
        a, b = (np.floor(rng.normal(size=(rng.integers(1, 30), 6)) * rng.uniform(0.1, 300) + rng.normal() * 100) for _ in "ab")
        lo, hi = H.interval(H.Ball(a, np.arange(len(a)), 99), H.Ball(b, np.arange(len(b)), 99))
        assert lo <= (a @ b.T).min() and (a @ b.T).max() <= hi


def test_edges(spark):
    assert H.digest(table(spark, [])).count() == 0
    assert H.digest(table(spark, [(100, [1.0, 2.0], 1)])).count() == 0
    assert H.digest(table(spark, [(None, None, None)])).count() == 0
    assert Scratch(spark, "x").root
