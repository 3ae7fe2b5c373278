"""The pipeline's stages on awkward rows, op3's fit against plain normal equations, and clashing names in written shards."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import quality_model, sharding, toxicity

FIELDS = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, kept boolean"


@pytest.fixture(scope="module")
def awkward(spark):
    texts = [None, "", " \n\t ", "one", "same words here and there", "same words here and there", "x" * 300_000, "long text of words " * 10_000, "日本語 🎉 text"]
    rows = [(i, t, None, "s", None, 0.5, 1, None) for i, t in enumerate(texts)]
    rows += [(4, texts[4], "en", None, 3, None, 2, True), (None, "no id at all in this row", "en", "s", 1, None, None, False)]
    return spark.createDataFrame(rows, FIELDS).repartition(3)


@pytest.fixture(scope="module")
def folder(spark, awkward, sf, tmp_path_factory):
    """The smallest tables, with the awkward rows among their documents."""
    out = str(tmp_path_factory.mktemp("awkward"))
    awkward.unionByName(spark.read.parquet(f"{sf}/documents.parquet"), allowMissingColumns=True).write.parquet(f"{out}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{out}/{name}.parquet")
    return out


def _keys(df):
    return sorted(((r.doc_id, r.text, r.lang, r.n_chars) for r in df.collect()), key=str)


@pytest.mark.parametrize("keep,column", [(quality_model.keep_good, "quality"), (toxicity.keep_civil, "toxic")])
def test_filters_keep_whole_rows(spark, folder, keep, column):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = keep(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert out.schema == docs.schema
    before, after = _keys(docs), _keys(out)
    assert 0 < len(after) <= len(before) and all(r in before for r in after)
    labels = spark.createDataFrame([], f"doc_id long, {column} int")
    assert _keys(keep(docs, labels)) == before  # nothing was learnt, so nothing goes
    assert keep(docs.limit(0), spark.read.parquet(f"{folder}/labels.parquet")).count() == 0


def test_pipeline_with_awkward_rows(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(rows[0].asDict())


def test_quality_fit_equals_plain_normal_equations(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality_model.labelled(docs, labels, "quality", 3, 1, quality_model.SAMPLE)
    rows = rows.withColumn("fitted", F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(4)) > 0).collect()
    x = quality_model.statistics(pa.array([r.text for r in rows], pa.string()))
    y, fitted = np.array([r.y for r in rows]), np.array([r.fitted for r in rows])
    spread = x.std(axis=0)
    z = np.clip((x - x.mean(axis=0)) / np.where(spread < 1e-9, 1.0, spread), -quality_model.CLIP, quality_model.CLIP)
    c = quality_model.cosines(z[fitted])
    penalty = quality_model.RIDGE * max(len(c), 1)
    plain = np.linalg.lstsq(np.vstack([c, np.sqrt(penalty) * np.eye(c.shape[1])]), np.concatenate([y[fitted], np.zeros(c.shape[1])]), rcond=None)[0]
    model = quality_model.fit(docs, labels)
    assert np.allclose(model.weights, plain, atol=1e-6)
    knots, values = quality_model.isotonic(quality_model.cosines(z[~fitted]) @ plain, y[~fitted])
    assert np.allclose(np.sort(model.knots), np.sort(knots), atol=1e-5) and np.allclose(model.values, values, atol=1e-6)


def test_written_shards_keep_all_clashing_names(spark, tmp_path):
    rows = [(i, f"t{i}", "s", i, -i, str(i)) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int, shard_ int, _row string")
    sharding.write_shards(df, str(tmp_path / "out"), 3)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {*out.columns} == {"doc_id", "text", "source", "shard__", "shard_", "_row", "shard", "slot"}
    assert sorted((r.doc_id, r.text, r.source, r.shard__, r.shard_, r._row) for r in out.collect()) == rows


def test_powers_are_kept_only_as_far_as_needed(monkeypatch):
    """A worker with short runs holds a small table; a longer run extends it with the same values."""
    from palimpsest.llm import wordvec

    monkeypatch.setattr(wordvec, "_powers", {})
    up, down = (x.copy() for x in wordvec.powers(1_000))
    assert len(up) < 1 << 17  # before, 2,097,153 at once
    more = wordvec.powers(200_000)
    assert all(len(x) >= 200_000 for x in more) and (more[0][: len(up)] == up).all() and (more[1][: len(down)] == down).all()
