import numpy as np
import pyarrow as pa
import pytest

from palimpsest.operators import nearest


def _plain(rows, threshold):
    out = {}
    for p, i, v in rows:
        for q, j, w in rows:
            if p == q and j < i and len(v) == len(w):
                c = round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 9)
                if c >= threshold and (i not in out or (c, -j) > (out[i][0], -out[i][1])):
                    out[i] = (c, j)
    return {i: (j, c) for i, (c, j) in out.items()}


def _got(df):
    return {r.id: (r.into_id, round(r.cos, 9)) for r in df.collect()}


@pytest.mark.parametrize(("block", "threshold"), [(2048, 0.95), (8, 0.95), (8, 0.3)])
def test_equals_plain_loops(spark, monkeypatch, block, threshold):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 16))
    rows = [("ab"[i % 3 == 0], i, (centres[i % 6] + rng.normal(scale=0.3, size=16)).tolist()) for i in range(160)]
    rows += [("a", 1000 + i, rows[7][2]) for i in range(12)]  # equal vectors
    rows += [("a", 2000 + i, [1.0, float(i)]) for i in range(5)]  # another dimension
    monkeypatch.setattr(nearest, "BLOCK", block)
    monkeypatch.setattr(nearest, "MEET", 3)
    df = spark.createDataFrame(rows, "part string, id long, vec array<double>").repartition(6)
    got = _got(nearest.nearest_earlier(df, threshold))
    assert got == _plain(rows, threshold)


def test_undefined_vectors_take_no_part(spark):
    rows = [("p", 1, [1.0, 0.0]), (None, 2, [1.0, 0.0]), ("p", None, [1.0, 0.0]), ("p", 3, None), ("p", 4, [0.0, 0.0]), ("p", 5, [float("nan"), 1.0]), ("p", 6, [float("inf"), 1.0]), ("p", 7, [None, 1.0]), ("p", 8, []), ("p", 9, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "part string, id long, vec array<double>")
    assert _got(nearest.nearest_earlier(df, 0.95)) == {9: (1, 1.0)}
    assert nearest.nearest_earlier(df.limit(0), 0.95).count() == 0


def test_one_part_of_many_rows_leaves_most_blocks_out(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(50, 32))
    n = 100_000
    vecs = centres[np.arange(n) % 50] + rng.normal(scale=0.02, size=(n, 32))
    lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * 32, vecs.ravel())
    df = spark.createDataFrame(pa.table({"part": ["one"] * n, "id": np.arange(n), "vec": lists})).repartition(16)
    got = nearest.nearest_earlier(df, 0.95).toPandas().set_index("id")
    assert len(got) == n - 50
    unit = vecs / np.linalg.norm(vecs, axis=1)[:, None]
    for i in rng.choice(np.arange(50, n), 40):
        cos = np.round(unit[:i] @ unit[i], 12)
        assert got.into_id[i] == cos.argmax() or abs(cos[got.into_id[i]] - cos.max()) < 1e-11
    blocks = nearest._blocks(df.withColumn("dim", nearest.F.lit(32)))
    k = blocks.count()
    assert nearest._meeting(blocks, 0.3176).count() < k * (k + 1) / 2 / 5
