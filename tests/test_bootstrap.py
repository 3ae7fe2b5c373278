import random

import pytest

from palimpsest.operators import bootstrap, evaluation


def _rows(spark, parts):
    rows = [(p, i, v) for p, vs in parts.items() for i, v in enumerate(vs)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "part string, qid long, delta double").repartition(5)


@pytest.mark.parametrize("block", [1 << 18, 7])
def test_parts_equal_the_plain_bootstrap(spark, monkeypatch, block):
    rng = random.Random(3)
    parts = {"a": [rng.choice([-1.0, 0.0, 1.0]) for _ in range(70)], "b": [1.0] * 9, "c": [-1.0, 0.0] * 40, "d": [0.5]}
    monkeypatch.setattr(bootstrap, "BLOCK", block)
    monkeypatch.setattr(bootstrap, "DRAWS", 2_000)  # several tasks
    got = {r.part: r for r in bootstrap.paired(_rows(spark, parts), resamples=400).collect()}
    assert set(got) == set(parts)
    for p, values in parts.items():
        want = evaluation.paired_bootstrap(values, 400)
        assert {k: got[p][k] for k in want} == want


def test_totals_of_blocks_add_up():
    values = bootstrap.np.arange(50.0)
    whole = bootstrap.totals(values, 50, 0, 3, 9, 5)
    assert (whole == bootstrap.totals(values[:20], 50, 0, 3, 9, 5) + bootstrap.totals(values[20:], 50, 20, 3, 9, 5)).all()


def test_nulls_and_nothing(spark):
    df = spark.createDataFrame([(None, 1, 1.0), (None, 2, None), ("x", 1, None)], "part string, qid long, delta double")
    assert [(r.part, r.n) for r in bootstrap.paired(df, resamples=20).collect()] == [(bootstrap.UNTYPED, 1)]
    assert bootstrap.paired(df.limit(0), resamples=20).count() == 0


def test_gate(spark):
    fields = "qid long, hit int, latency double, degraded boolean, error boolean, kind string"
    base = spark.createDataFrame([(i, int(i % 2), 1.0, False, False, "k" if i < 40 else None) for i in range(80)], fields)
    better = spark.createDataFrame([(i, 1, 1.0, False, False, None) for i in range(80)], fields).drop("kind")
    got = bootstrap.gate(base, better, ["kind"], resamples=500).first()
    assert got.passed and got.reasons == "" and (got.fixed, got.broken) == (40, 0)
    mixed = spark.createDataFrame([(i, int(i >= 40), 2.0, i == 3, None, None) for i in range(1, 80)], fields).drop("kind")
    got = bootstrap.gate(base, mixed, ["kind"], resamples=500).first()
    assert got.reasons == "incomplete,not_significant,subgroup,slower,degraded" and got.regressing == "kind:k"
    assert bootstrap.gate(base.limit(0), better.limit(0), ["kind"], resamples=20).first().reasons == "incomplete,not_significant"
