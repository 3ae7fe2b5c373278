"""Paired bootstrap of any number of parts at once, and the promotion gate that rests on it.

The seeded stream is counter-based: number k of it follows from k alone. So draw
j of resample i is number ``i * n + j``, whichever task takes it. A part's
differences lie in blocks of ``BLOCK``; a task draws the indices of some
resamples and adds up those that fall in its block, in order. What meets at the
end of a part is one mean for each resample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from palimpsest.operators.evaluation import mulberry_block
from palimpsest.sources.shared import folder, stored

#: Differences in a block; draws of a task at once, and of a task in all.
BLOCK, STEP, DRAWS = 1 << 18, 1 << 20, 20_000_000
UNTYPED = "__untyped__"


def _placed(rows: DataFrame) -> DataFrame:
    """(part, at, n, delta): rows (part, key, delta) with their place in their part, by key; ranges are sorted apart, and shifted by those before."""
    ordered = rows.orderBy("part", "key", "delta").withColumn("_id", F.monotonically_increasing_id())
    rows = stored(ordered, f"{folder(rows.sparkSession)}/deltas").withColumn("run", F.shiftright("_id", 33))
    runs = rows.groupBy("part", "run").agg(F.count("*").alias("m"), F.min("_id").alias("first"))
    before = F.coalesce(F.sum("m").over(W.partitionBy("part").orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("part", "run", (before - F.col("first")).alias("shift"), F.sum("m").over(W.partitionBy("part")).alias("n"))
    return rows.join(runs, ["part", "run"]).select("part", (F.col("_id") + F.col("shift")).alias("at"), "n", "delta")


def totals(values: np.ndarray, n: int, low: int, first: int, last: int, seed: int) -> np.ndarray:
    """For each resample from first to last, the sum of its draws that fall in values, which are numbers low and on of n."""
    out = np.zeros(last - first)
    many = max(1, STEP // n)  # resamples at once
    for i in range(first, last, many):
        k = min(many, last - i)
        for j in range(0, n, STEP):
            width = min(STEP, n - j)
            drawn = (mulberry_block(seed, i * n + j, k * width) * n).astype(np.int64).reshape(k, width) - low
            inside = (drawn >= 0) & (drawn < len(values))
            some = np.where(inside, values[np.where(inside, drawn, 0)], 0.0)
            some[:, 0] += out[i - first : i - first + k]
            out[i - first : i - first + k] = np.cumsum(some, axis=1)[:, -1]  # added in order
    return out


def paired(rows: DataFrame, part: str = "part", key: str = "qid", value: str = "delta", resamples: int = 10_000, seed: int = 42, comparisons: int = 12) -> DataFrame:
    """(part, n, mean, low, high, p, adjusted_p, improves, regresses) of the paired differences of each part.

    The interval holds 1 - 0.05 / comparisons of the resampled means; p is two-sided and multiplied
    by comparisons for adjusted_p. Differences are taken by rising key, then value; null
    ones take no part; a null part is a part of its own; no rows give no row. Sums of a part of more than
    ``BLOCK`` differences are rounded by block.
    """
    spark = rows.sparkSession
    kept = rows.select(F.coalesce(F.col(part).cast("string"), F.lit(UNTYPED)).alias("part"), F.col(key).alias("key"), F.col(value).cast("double").alias("delta")).where("delta IS NOT NULL")
    blocks = _placed(kept).groupBy("part", "n", F.floor(F.col("at") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", "delta"))).alias("d"))
    tasks = F.least(F.lit(resamples), F.ceil(F.col("n") * resamples / DRAWS)).cast("int")
    blocks = blocks.select("part", "n", "block", F.transform("d", lambda x: x["delta"]).alias("d"), tasks.alias("tasks"))
    dealt = blocks.withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part", "block", "task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                p, n, block, d, tasks, task = (batch.column(c)[i] for c in range(6))
                n, block, tasks, task = n.as_py(), block.as_py(), tasks.as_py(), task.as_py()
                values = d.values.to_numpy(zero_copy_only=False)
                first, last = task * resamples // tasks, (task + 1) * resamples // tasks
                names, sums = np.arange(first, last), totals(values, n, block * BLOCK, first, last, seed)
                if task == 0:  # as resample -1, the differences themselves
                    names, sums = np.append(names, -1), np.append(sums, np.cumsum(values)[-1])
                m = len(names)
                cols = [pa.array([p.as_py()] * m), pa.array(np.full(m, n)), pa.array(np.full(m, block)), pa.array(names), pa.array(sums)]
                yield pa.RecordBatch.from_arrays(cols, ["part", "n", "block", "resample", "total"])

    sums = dealt.select("part", "n", "block", "d", "tasks", "task").mapInArrow(run, "part string, n long, block long, resample long, total double")
    added = F.aggregate(F.array_sort(F.collect_list(F.struct("block", "total"))), F.lit(0.0), lambda s, x: s + x["total"])
    means = sums.groupBy("part", "n", "resample").agg(added.alias("total")).select("part", "n", "resample", (F.col("total") / F.col("n")).alias("mean"))
    all_of = means.groupBy("part", "n").agg(F.max(F.when(F.col("resample") < 0, F.col("mean"))).alias("mean"), F.array_sort(F.collect_list(F.when(F.col("resample") >= 0, F.col("mean")))).alias("m"))
    at = lambda q: F.element_at("m", min(resamples - 1, max(0, math.floor(q * resamples))) + 1)
    alpha = 0.05 / comparisons
    fewer = F.least(F.size(F.filter("m", lambda x: x <= 0)), F.size(F.filter("m", lambda x: x >= 0)))
    p = F.least(F.lit(1.0), 2 * fewer / F.lit(resamples))
    out = all_of.select("part", "n", "mean", at(alpha / 2).alias("low"), at(1 - alpha / 2).alias("high"), p.alias("p"), F.least(F.lit(1.0), p * comparisons).alias("adjusted_p"))
    sure = F.col("adjusted_p") < 0.05
    return out.withColumn("improves", (F.col("low") > 0) & sure).withColumn("regresses", (F.col("high") < 0) & sure)


def gate(base: DataFrame, candidate: DataFrame, parts: list[str], slower: float = 1.1, **options) -> DataFrame:
    """One row: whether the candidate may replace the base, and why not.

    Rows are (qid, hit, latency, degraded, error) and, in base, the columns named in parts. Reasons: ``incomplete``
    (a question is on one side only), ``not_significant`` (the overall interval or adjusted p), ``subgroup`` (a significant
    regression in any value of any part, named in ``regressing``), ``slower`` (nearest-rank 95th percentile beyond the given
    ratio), ``degraded`` (any degraded or failed row on either side). Empty sides give ``incomplete``.
    """
    b = base.select("qid", F.col("hit").alias("b"), *parts, F.lit(True).alias("in_b"))
    pairs = b.join(candidate.select("qid", F.col("hit").alias("c"), F.lit(True).alias("in_c")), "qid", "full")
    labels = F.array(F.lit("all"), *[F.concat(F.lit(f"{p}:"), F.coalesce(F.col(p).cast("string"), F.lit(UNTYPED))) for p in parts])
    both = pairs.where("in_b AND in_c")
    tested = paired(both.select("qid", (F.col("c") - F.col("b")).alias("delta"), F.explode(labels).alias("part")), **options)
    overall = F.max(F.when(F.col("part") == "all", F.struct("mean", "low", "high", "p", "adjusted_p", "improves")))
    t = tested.agg(overall.alias("o"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("regresses") & (F.col("part") != "all"), F.col("part")))), ",").alias("regressing"))
    counts = pairs.agg(
        F.count_if(F.col("in_b").isNull() | F.col("in_c").isNull()).alias("apart"), F.count("*").alias("pairs"),
        F.count_if((F.col("b") == 0) & (F.col("c") == 1)).alias("fixed"), F.count_if((F.col("b") == 1) & (F.col("c") == 0)).alias("broken"),
    )
    p95 = F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency)")
    bad = F.count_if(F.coalesce(F.col("degraded"), F.lit(False)) | F.coalesce(F.col("error"), F.lit(False)))
    one = t.crossJoin(counts).crossJoin(base.agg(p95.alias("bl"), bad.alias("bb"))).crossJoin(candidate.agg(p95.alias("cl"), bad.alias("cb")))  # single rows
    ratio = F.when(F.col("bl") == 0, F.lit(math.inf)).otherwise(F.try_divide("cl", "bl"))
    why = F.array_compact(F.array(
        F.when((F.col("apart") > 0) | (F.col("pairs") == 0), "incomplete"),
        F.when(~F.coalesce(F.col("o.improves"), F.lit(False)), "not_significant"),
        F.when(F.col("regressing") != "", "subgroup"),
        F.when(ratio > slower, "slower"),
        F.when(F.col("bb") + F.col("cb") > 0, "degraded"),
    ))
    return one.select((F.size(why) == 0).alias("passed"), F.array_join(why, ",").alias("reasons"), "o.mean", "o.low", "o.high", "o.p", "o.adjusted_p", "regressing", ratio.alias("latency_ratio"), "fixed", "broken")
