"""Junk gate, degradation and duplicates of content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

LEAST_CHARS, MOST_UNPRINTABLE, MOST_RUN = 40, 0.1, 2_000
#: Share of skipped units above which a file counts as degraded.
DEGRADED = {"pdf": 0.3, "xlsx": 0.8}


def junk_gate(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds verdict: ok, empty, too_short, binary or no_word_boundaries."""
    x = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "^[ \\t-\\r]+|[ \\t-\\r]+$", "")
    bad = F.regexp_count(F.col("_x"), F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F�]"))
    run = F.array_max(F.transform(F.split("_x", "[ \\t\\n\\r\\f]+"), lambda w: F.length(w)))
    n = F.length("_x")
    verdict = F.when(n == 0, "empty").when(n < LEAST_CHARS, "too_short").when(bad > MOST_UNPRINTABLE * n, "binary").when(run > MOST_RUN, "no_word_boundaries").otherwise("ok")
    return df.withColumn("_x", x).withColumn("verdict", verdict).drop("_x")


def degraded(fmt: Column, extracted: Column, skipped: Column, clamped: Column) -> Column:
    limit = F.lit(0.5)
    for name, v in DEGRADED.items():
        limit = F.when(fmt == name, v).otherwise(limit)
    total = extracted + skipped
    return clamped | (total == 0) | (skipped / F.greatest(total, F.lit(1)) > limit)


def content_duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    """Adds sha, whether the row is its content's first, and how many share it."""
    hashed = df.select(key, F.sha2(text, 256).alias("sha"))
    # counts first, so that one content of many copies is not one task's window
    per = hashed.groupBy("sha").agg(F.min(key).alias("_first"), F.count("*").alias("copies"))
    return hashed.join(per, "sha").select(key, "sha", (F.col(key) == F.col("_first")).alias("first"), "copies")


def fingerprints(df: DataFrame, part: str, text: str) -> DataFrame:
    """(part, fingerprint, n): a hash of each part's texts whatever their order, from the hashes of 4,096 ranges."""
    rows = df.select(part, F.sha2(text, 256).alias("h")).groupBy(part, F.substring("h", 1, 3).alias("bin"))
    bins = rows.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), "\n"), 256).alias("h"), F.count("*").alias("n"))
    line = F.concat("bin", F.lit(":"), "h")
    return bins.groupBy(part).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("fingerprint"), F.sum("n").alias("n"))
