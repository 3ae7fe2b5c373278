"""Retrieval metrics, samples, paired comparison and promotion gates.

Ranked frames are long: (qid, rank, slug), rank from 1; relevance is
(qid, gold: array of slugs). Empty gold gives NULL, left out of means.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Accuracy of the percentile sketch and the share of rows kept on each side of it; hash ranges as a power of two.
SKETCH, MARGIN, BINS = 10_000, 0.001, 12


def lists(ranked: DataFrame) -> DataFrame:
    """(qid, slugs) in order of rank."""
    return ranked.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "slug"))), lambda x: x["slug"]).alias("slugs"))


def first_rank(slugs: Column, gold: Column) -> Column:
    """The first position of any gold slug, NULL if none."""
    return F.array_min(F.filter(F.transform(slugs, lambda s, i: F.when(F.array_contains(gold, s), i + 1)), lambda x: x.isNotNull()))


def hit_mrr(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, hit1, hit3, rr); no gold or no list counts as a miss."""
    j = gold.join(lists(ranked), "qid", "left").withColumn("r", first_rank(F.coalesce("slugs", F.array().cast("array<string>")), F.col("gold")))
    hit = lambda k: F.coalesce((F.col("r") <= k).cast("int"), F.lit(0))
    return j.select("qid", hit(1).alias("hit1"), hit(3).alias("hit3"), F.round(F.coalesce(1 / F.col("r"), F.lit(0.0)), 9).alias("rr"))


def multihop(ranked: DataFrame, gold: DataFrame, ks=(4, 8)) -> DataFrame:
    """(qid, all@k, evidence@k, docs@k of each k, hit1, rr) over distinct documents of the first k slots; NULL without gold."""
    j = gold.join(lists(ranked), "qid", "left").withColumn("slugs", F.coalesce("slugs", F.array().cast("array<string>")))
    some, n = F.size("gold") > 0, F.size("gold")
    cols = []
    for k in ks:
        head = F.array_distinct(F.slice("slugs", 1, k))
        got = F.size(F.array_intersect(head, F.col("gold")))
        cols += [F.when(some, (got == n).cast("int")).alias(f"all_{k}"), F.when(some, F.round(got / n, 9)).alias(f"evidence_{k}"), F.size(head).alias(f"docs_{k}")]
    r = first_rank(F.array_distinct("slugs"), F.col("gold"))
    return j.select("qid", *cols, F.when(some, F.coalesce((r == 1).cast("int"), F.lit(0))).alias("hit1"), F.when(some, F.round(F.coalesce(1 / r, F.lit(0.0)), 9)).alias("rr"))


def candidate_recall(pool: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, recall): the share of gold in the pool (qid, slug)."""
    p = pool.groupBy("qid").agg(F.collect_set("slug").alias("pool"))
    j = gold.join(p, "qid", "left")
    return j.select("qid", F.when(F.size("gold") > 0, F.round(F.size(F.array_intersect(F.coalesce("pool", F.array().cast("array<string>")), F.col("gold"))) / F.size("gold"), 9)).alias("recall"))


def precision_at_5(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, p5, r5, rr) on first occurrences of pages; the precision's denominator is always five."""
    j = gold.join(lists(ranked), "qid", "left").withColumn("d", F.array_distinct(F.coalesce("slugs", F.array().cast("array<string>"))))
    got = F.size(F.array_intersect(F.slice("d", 1, 5), F.col("gold")))
    r = first_rank(F.col("d"), F.col("gold"))
    return j.select("qid", F.round(got / 5, 9).alias("p5"), F.when(F.size("gold") > 0, F.round(got / F.size("gold"), 9)).alias("r5"), F.round(F.coalesce(1 / r, F.lit(0.0)), 9).alias("rr"))


def conversation_recall(ranked: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """(qid, recall_all, recall_any, evidence) over the first k slots, repeats filling slots."""
    j = gold.join(lists(ranked), "qid", "left")
    got = F.size(F.array_intersect(F.slice(F.coalesce("slugs", F.array().cast("array<string>")), 1, k), F.col("gold")))
    some = F.size("gold") > 0
    return j.select("qid", F.when(some, (got == F.size("gold")).cast("int")).alias("recall_all"), F.when(some, (got > 0).cast("int")).alias("recall_any"), F.when(some, F.round(got / F.size("gold"), 9)).alias("evidence"))


def cap_replay(ranked: DataFrame, most: int) -> DataFrame:
    """The list as a tighter per-page cap would have left it, ranks closed up."""
    w = W.partitionBy("qid", "slug").orderBy("rank")
    kept = ranked.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most)
    return kept.select("qid", F.row_number().over(W.partitionBy("qid").orderBy("rank")).alias("rank"), "slug")


def value_at(df: DataFrame, part: str, value: str, near: float, rank) -> DataFrame:
    """(part, value, n): the value of the given rank of each part, NULL values left out; rank makes one of the number of rows.

    A sketch (its error is bounded by ``1 / SKETCH`` of the rows) gives a narrow
    range of values around the share ``near``; rows below are only counted, and
    those inside are counted by value, so no part is sorted as a whole.
    """
    rows = df.select(part, F.col(value).alias("_v")).where("_v IS NOT NULL")
    at = lambda p: F.percentile_approx("_v", min(1.0, max(0.0, p)), SKETCH)
    ends = rows.groupBy(part).agg(at(near - MARGIN).alias("_lo"), at(near + MARGIN).alias("_hi"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.count("*").alias("n"))
    ends = ends.select(part, F.when(F.lit(near <= MARGIN), F.col("_min")).otherwise(F.col("_lo")).alias("_lo"), F.when(F.lit(near >= 1 - MARGIN), F.col("_max")).otherwise(F.col("_hi")).alias("_hi"), "n")
    inside = rows.withColumnRenamed(part, "_p").join(ends, F.col("_p").eqNullSafe(F.col(part))).where("_v <= _hi")
    counts = inside.groupBy(part, "n", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(W.partitionBy(part).orderBy(F.asc_nulls_first("_v")).rowsBetween(W.unboundedPreceding, W.currentRow))
    found = counts.withColumn("_upto", upto).where(F.col("_v").isNotNull() & (F.col("_upto") >= rank(F.col("n"))))
    return found.groupBy(part).agg(F.min("_v").alias("value"), F.max("n").alias("n"))


def nearest_rank(df: DataFrame, part: str, value: str, p: float) -> DataFrame:
    """The ceil(p n)-th smallest value of each part."""
    return value_at(df, part, value, p, lambda n: F.greatest(F.lit(1), F.ceil(F.lit(p) * n))).select(part, "value")


def timings(df: DataFrame, part: str, value: str) -> DataFrame:
    """Least, upper median (not interpolated) and greatest value of each part."""
    ends = df.where(F.col(value).isNotNull()).groupBy(F.col(part).alias("_p")).agg(F.min(value).alias("least"), F.max(value).alias("greatest"))
    mid = value_at(df, part, value, 0.5, lambda n: F.floor(n / 2) + 1)
    return mid.join(ends, F.col("_p").eqNullSafe(F.col(part))).select(part, "least", F.col("value").alias("median"), "greatest", "n")


def mean_std(df: DataFrame, part: str, value: str) -> DataFrame:
    """Mean and sample deviation, the latter 0 for one row."""
    return df.groupBy(part).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 6).alias("std"))


def summary(rows: DataFrame, part: str) -> DataFrame:
    """Quality of good rows and latency and counts of all, for each part and overall (part NULL)."""
    good = ~F.col("degraded") & ~F.col("error")
    g = rows.select(part, "latency", "degraded", "error", F.when(good, F.col("hit")).alias("q")).groupingSets([[part], []], part)
    return g.agg(F.round(F.avg("q"), 6).alias("quality"), F.round(F.avg("latency"), 6).alias("latency"), F.count("*").alias("n"), F.count_if(F.col("degraded")).alias("degraded"), F.count_if(F.col("error")).alias("errors"))


def fixed_broken(base: DataFrame, candidate: DataFrame, part: str) -> DataFrame:
    """How many rows (qid, part, hit) the candidate turned to hits, and how many it lost."""
    j = base.select("qid", part, F.col("hit").alias("b")).join(candidate.select("qid", F.col("hit").alias("c")), "qid")
    return j.groupBy(part).agg(F.count_if((F.col("b") == 0) & (F.col("c") == 1)).alias("fixed"), F.count_if((F.col("b") == 1) & (F.col("c") == 0)).alias("broken"), F.round(F.avg(F.col("c") - F.col("b")), 9).alias("delta"))


def promotion_gate(base: DataFrame, candidate: DataFrame, part: str, slower: float = 1.1, worst: float = -0.02) -> DataFrame:
    """One row: the reasons against promotion (none means pass)."""
    per = fixed_broken(base, candidate, part).agg(F.min("delta").alias("worst"))
    slow = F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency)")  # the nearest rank, from partial counts
    b, c = base.agg(slow.alias("b")), candidate.agg(slow.alias("c"))
    bad = candidate.agg(F.count_if(F.col("degraded") | F.col("error")).alias("bad"))
    mean = base.agg(F.avg("hit").alias("bm")).crossJoin(candidate.agg(F.avg("hit").alias("cm")))
    one = per.crossJoin(b).crossJoin(c).crossJoin(bad).crossJoin(mean)  # single rows
    why = F.array_compact(F.array(F.when(F.col("cm") <= F.col("bm"), "no_gain"), F.when(F.col("worst") < worst, "subgroup"), F.when(F.col("c") > slower * F.col("b"), "slower"), F.when(F.col("bad") > 0, "degraded")))
    return one.select(F.array_join(why, ",").alias("reasons"), (F.size(why) == 0).alias("passed"))


def regressions(before: DataFrame, after: DataFrame) -> DataFrame:
    """(qid, what): rows (qid, hit, metric) that are gone, flipped, or worse."""
    j = before.select("qid", F.col("hit").alias("b"), F.col("metric").alias("m")).join(after.select("qid", F.col("hit").alias("c"), F.col("metric").alias("n"), F.lit(True).alias("there")), "qid", "left")
    what = F.when(F.col("there").isNull(), "omitted").when((F.col("b") == 1) & (F.col("c") == 0), "flipped").when(F.col("n") < F.col("m"), "decreased")
    return j.select("qid", what.alias("what")).where("what IS NOT NULL")


def _quotas(sizes: DataFrame, part: str, n, exact) -> DataFrame:
    """(part, quota) by largest remainder: n rows in all, from sizes (part, size, total)."""
    share = sizes.withColumn("exact", exact).withColumn("base", F.floor("exact"))
    left = n - F.sum("base").over(W.partitionBy())
    order = F.row_number().over(W.orderBy(F.desc(F.round(F.col("exact") - F.col("base"), 9)), F.asc(part)))
    return share.withColumn("quota", F.col("base") + (order <= left).cast("int")).select(part, "size", "quota")


def _first_by_hash(df: DataFrame, key: str, part: str, quota: DataFrame, seed: str) -> DataFrame:
    """df with _in: whether a row is among the quota of its part that come first by the 48 leading bits of a seeded SHA-256.

    Counts by ``BINS`` ranges of the hash tell which ranges lie wholly inside the
    quota; only the range that it cuts is ranked, so no part is sorted as a whole.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), 1, 12), 16, 10).cast("long")
    rows = df.withColumn("_h", h).withColumn("_bin", F.shiftright("_h", 48 - BINS))
    bins = rows.groupBy(part, "_bin").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(W.partitionBy(part).orderBy("_bin").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_c")
    room = bins.withColumn("_before", before).join(quota.select(part, "quota"), part).select(part, "_bin", "_c", (F.col("quota") - F.col("_before")).alias("_room"))
    rows = rows.join(room, [part, "_bin"])
    whole = rows.where("_room <= 0 OR _room >= _c").withColumn("_in", F.col("_room") > 0)
    cut = rows.where("_room > 0 AND _room < _c").withColumn("_in", F.row_number().over(W.partitionBy(part, "_bin").orderBy("_h", key)) <= F.col("_room"))
    return whole.unionByName(cut).drop("_h", "_bin", "_c", "_room")


def hash_sample(df: DataFrame, key: str, part: str, n: int, seed: str = "42") -> DataFrame:
    """n rows spread over the parts by largest remainder, chosen by a seeded hash."""
    sizes = df.groupBy(part).agg(F.count("*").alias("size"))
    sizes = sizes.crossJoin(F.broadcast(sizes.agg(F.sum("size").alias("total"))))  # one row
    quota = _quotas(sizes, part, F.lit(n), F.col("size") * n / F.col("total"))
    return _first_by_hash(df, key, part, quota, seed).where("_in").drop("_in")


def joint_split(questions: DataFrame, share: float = 0.7, seed: str = "42") -> DataFrame:
    """Questions (qid, type, hops) with their side, tuning or holdout: the share of each (type, hops), by largest remainder to its share of all.

    Whatever the order of the rows, the same ones are drawn: by a seeded hash of the id.
    """
    if not 0 <= share <= 1:
        raise ValueError("share must be between 0 and 1")
    q = questions.withColumn("_g", F.concat(F.coalesce("type", F.lit("untyped")), F.lit("\u0000"), F.col("hops").cast("string")))
    sizes = q.groupBy("_g").agg(F.count("*").alias("size"))
    sizes = sizes.crossJoin(F.broadcast(sizes.agg(F.sum("size").alias("total"))))  # one row
    quota = _quotas(sizes, "_g", F.floor(F.col("total") * share + 0.5), F.col("size") * share)
    out = _first_by_hash(q, "qid", "_g", quota, seed)
    return out.withColumn("side", F.when(F.col("_in"), "tuning").otherwise("holdout")).drop("_in", "_g")


def cap_bound(rows: DataFrame, k: int, cap: int, per_page: int = 3) -> DataFrame:
    """One row: what recall a tighter page cap could reach at most, from rows (qid, k, recall, docs) at several cutoffs.

    A list of k places with so many documents has at most (k - docs) // (per_page - 1)
    pages at the old cap; the places that they would give up hold new documents at
    best, so the recall at the next cutoff bounds the new one.
    """
    here = rows.where((F.col("k") == k) & F.col("recall").isNotNull()).select("qid", "recall", "docs")
    full = F.greatest(F.lit(0), F.floor((k - F.col("docs")) / max(1, per_page - 1)))
    here = here.withColumn("more", full * max(0, per_page - cap))
    later = rows.where("recall IS NOT NULL").select("qid", F.col("k").alias("_k"), F.col("recall").alias("_r"))
    j = here.join(later, "qid", "left").groupBy("qid", "recall", "docs", "more")  # a few cutoffs a question
    best = j.agg(F.min_by("_r", F.when(F.col("_k") >= k + F.col("more"), F.col("_k"))).alias("_b"))
    mean = lambda c, name: F.round(F.avg(c), 9).alias(name)
    return best.agg(mean("recall", "baseline"), mean(F.coalesce("_b", "recall"), "bound"), F.count("*").alias("n"), mean("docs", "mean_docs"), mean(F.col("docs") + F.col("more"), "ceiling_docs"))


#: Outputs that no page can answer.
ANSWER_ONLY = ("answer-string", "canonical-entity-id", "time-qualified-answer", "contradiction-explanation", "poison-flag", "confidence-score")


def gold_partition(rows: DataFrame) -> DataFrame:
    """(qid, kind) of rows (qid, example, abstains, relevant, output, expects): example, abstention, answer_only or candidate.

    An abstention with relevant pages contradicts itself and is marked as invalid.
    """
    example, abstains = F.coalesce("example", F.lit(False)), F.coalesce("abstains", F.lit(False))
    some = F.coalesce(F.size("relevant") > 0, F.lit(False))
    only = F.col("relevant").isNull() & F.coalesce(F.col("output").isin(*ANSWER_ONLY), F.lit(False)) & F.coalesce("expects", F.lit(False))
    kind = F.when(example, "example").when(abstains & some, "invalid").when(abstains, "abstention").when(only, "answer_only").otherwise("candidate")
    return rows.select("qid", kind.alias("kind"))


# --- on the driver: seeded sequences that must not depend on partitions -------

def mulberry(seed: int):
    """A 32-bit generator of numbers in [0, 1)."""
    state, mask = seed & 0xFFFFFFFF, 0xFFFFFFFF
    while True:
        state = (state + 0x6D2B79F5) & mask
        t = ((state ^ state >> 15) * (state | 1)) & mask
        t ^= (t + (((t ^ t >> 7) * (t | 61)) & mask)) & mask
        yield (t ^ t >> 14) / 4294967296


def mulberry_block(seed: int, start: int, count: int) -> np.ndarray:
    """Numbers start to start + count of mulberry(seed), as an array."""
    k = np.arange(start + 1, start + count + 1, dtype=np.uint64)
    state = (np.uint64(seed & 0xFFFFFFFF) + k * np.uint64(0x6D2B79F5)).astype(np.uint32)
    t = (state ^ state >> np.uint32(15)) * (state | np.uint32(1))
    t ^= t + (t ^ t >> np.uint32(7)) * (t | np.uint32(61))
    return (t ^ t >> np.uint32(14)) / 4294967296


def paired_bootstrap(deltas: list[float], resamples: int = 10_000, seed: int = 42, comparisons: int = 12) -> dict:
    """Mean difference, its interval at 5 % over the comparisons, and p-values, from one seeded stream."""
    if not deltas:
        raise ValueError("no paired differences")
    values, n, means = np.asarray(deltas, float), len(deltas), []
    for i in range(resamples):
        total = 0.0
        for j in range(0, n, 1_000_000):
            some = values[(mulberry_block(seed, i * n + j, min(1_000_000, n - j)) * n).astype(np.int64)]
            some[0] += total
            total = float(np.cumsum(some)[-1])  # added in order
        means.append(total / n)
    means.sort()
    at = lambda p: means[min(resamples - 1, max(0, math.floor(p * resamples)))]
    alpha = 0.05 / comparisons
    raw = min(1.0, 2 * min(sum(m <= 0 for m in means), sum(m >= 0 for m in means)) / resamples)
    low, high, adjusted = at(alpha / 2), at(1 - alpha / 2), min(1.0, raw * comparisons)
    return {"mean": sum(deltas) / n, "low": low, "high": high, "p": raw, "adjusted_p": adjusted, "improves": low > 0 and adjusted < 0.05, "regresses": high < 0 and adjusted < 0.05}


def winner(rows: DataFrame) -> DataFrame:
    """The best profile: recall, evidence, reciprocal rank, then speed and name."""
    return rows.orderBy(F.desc("all_8"), F.desc("evidence_8"), F.desc("mrr"), F.asc("p95"), F.asc("name")).limit(1)
