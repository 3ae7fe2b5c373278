"""Evaluation queries over a known-item frame, and event-time extensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import evaluation as E
from palimpsest.plans.registry import query
from palimpsest.sources.tables import table
from palimpsest.streaming import events as S

# Question q is document q; its list visits ten documents by a fixed rule, the first right one at a place that
# the id decides; gold is the document itself and the first one of the same text, which stands for all copies.
FRAME = """
gold AS (SELECT doc_id AS qid, CASE WHEN doc_id % 70 = 0 THEN [] ELSE list_distinct(['doc-' || doc_id, 'doc-' || min(doc_id) OVER (PARTITION BY text)]) END AS gold FROM documents),
ranked AS (SELECT doc_id AS qid, CAST(r AS INTEGER) AS rank, 'doc-' || CASE WHEN r = (doc_id // 10) % 7 + 1 THEN doc_id WHEN r = 9 THEN doc_id + 1 ELSE (doc_id + (r - r % 2) * 3) % (SELECT count(*) FROM documents) END AS slug FROM documents, range(1, 11) t(r)),
ls AS (SELECT qid, list(slug ORDER BY rank) AS slugs FROM ranked GROUP BY qid),
j AS (SELECT gold.qid, gold, slugs, list_filter(slugs, lambda s, i: list_position(slugs, s) = i) AS d FROM gold JOIN ls USING (qid)),
"""
_FIRST = "list_min(list_filter(list_transform({0}, lambda s, i: CASE WHEN list_contains(gold, s) THEN i END), lambda x: x IS NOT NULL))"


def _w(body: str, more: str = "") -> str:
    return f"WITH {FRAME} {more} last AS (SELECT 1) {body}"


def gold(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first"))
    both = F.array_distinct(F.array(F.concat(F.lit("doc-"), "doc_id"), F.concat(F.lit("doc-"), "first")))
    return docs.join(first, "h").select(F.col("doc_id").alias("qid"), F.when(F.col("doc_id") % 70 == 0, F.array().cast("array<string>")).otherwise(both).alias("gold"))


def ranked(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    n = F.broadcast(docs.agg(F.count("*").alias("n")))  # one row
    q = docs.crossJoin(n).withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(10))))
    i, r = F.col("doc_id"), F.col("r")
    to = F.when(r == F.expr("doc_id div 10") % 7 + 1, i).when(r == 9, i + 1).otherwise((i + (r - r % 2) * 3) % F.col("n"))
    return q.select(i.alias("qid"), r.alias("rank"), F.concat(F.lit("doc-"), to).alias("slug"))


@query(_w(f"SELECT qid, CAST(coalesce({_FIRST.format('slugs')} <= 1, false) AS INTEGER) AS hit1, CAST(coalesce({_FIRST.format('slugs')} <= 3, false) AS INTEGER) AS hit3, round(coalesce(1.0::DOUBLE / {_FIRST.format('slugs')}, 0), 9) AS rr FROM j"))
def hit_mrr(spark, d):
    return E.hit_mrr(ranked(spark, d), gold(spark, d))


_INTER = "len(list_filter({0}, lambda s: list_contains(gold, s)))"
_DK = "list_filter(slugs[1:{0}], lambda s, i: list_position(slugs, s) = i)"


@query(_w("SELECT qid, " + ", ".join(f"CASE WHEN len(gold) > 0 THEN CAST({_INTER.format(_DK.format(k))} = len(gold) AS INTEGER) END AS all_{k}, CASE WHEN len(gold) > 0 THEN round({_INTER.format(_DK.format(k))} / len(gold), 9) END AS evidence_{k}, CAST(len({_DK.format(k)}) AS INTEGER) AS docs_{k}" for k in (4, 8)) + f", CASE WHEN len(gold) > 0 THEN CAST(coalesce({_FIRST.format('d')} = 1, false) AS INTEGER) END AS hit1, CASE WHEN len(gold) > 0 THEN round(coalesce(1.0::DOUBLE / {_FIRST.format('d')}, 0), 9) END AS rr FROM j"))
def multihop_recall(spark, d):
    return E.multihop(ranked(spark, d), gold(spark, d))


@query(_w(f"SELECT qid, CASE WHEN len(gold) > 0 THEN round({_INTER.format('d')} / len(gold), 9) END AS recall FROM j"))
def candidate_recall(spark, d):
    return E.candidate_recall(ranked(spark, d), gold(spark, d))


@query(_w(f"SELECT qid, round({_INTER.format('d[1:5]')} / 5, 9) AS p5, CASE WHEN len(gold) > 0 THEN round({_INTER.format('d[1:5]')} / len(gold), 9) END AS r5, round(coalesce(1.0::DOUBLE / {_FIRST.format('d')}, 0), 9) AS rr FROM j"))
def p_at_5(spark, d):
    return E.precision_at_5(ranked(spark, d), gold(spark, d))


@query(_w(f"SELECT qid, CASE WHEN len(gold) > 0 THEN CAST({_INTER.format(_DK.format(5))} = len(gold) AS INTEGER) END AS recall_all, CASE WHEN len(gold) > 0 THEN CAST({_INTER.format(_DK.format(5))} > 0 AS INTEGER) END AS recall_any, CASE WHEN len(gold) > 0 THEN round({_INTER.format(_DK.format(5))} / len(gold), 9) END AS evidence FROM j"))
def conv_recall(spark, d):
    return E.conversation_recall(ranked(spark, d), gold(spark, d))


@query(_w("SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY rank) AS INTEGER) AS rank, slug FROM (SELECT *, row_number() OVER (PARTITION BY qid, slug ORDER BY rank) AS k FROM ranked) WHERE k <= 1"))
def cap_replay(spark, d):
    return E.cap_replay(ranked(spark, d), 1)


@query("SELECT event_type, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE i = greatest(1, ceil(0.95::DOUBLE * n))")
def pctl_nearest_rank(spark, d):
    return E.nearest_rank(table(spark, d, "events"), "event_type", "value", 0.95)


@query("SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std FROM events GROUP BY user_id")
def mean_std(spark, d):
    return E.mean_std(table(spark, d, "events"), "user_id", "value")


_RUNS = "b AS (SELECT event_id AS qid, event_type AS kind, value AS latency, event_id % 40 = 0 AS degraded, event_id % 97 = 0 AS error, CAST(event_id % 3 = 0 AS INTEGER) AS hit FROM events), c AS (SELECT event_id AS qid, event_type AS kind, value * 1.05::DOUBLE AS latency, false AS degraded, false AS error, CAST(event_id % 3 = 0 AND event_id % 7 <> 0 OR event_id % 4 = 1 AS INTEGER) AS hit FROM events)"


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e, i = table(spark, d, "events"), F.col("event_id")
    base = e.select(i.alias("qid"), F.col("event_type").alias("kind"), F.col("value").alias("latency"), (i % 40 == 0).alias("degraded"), (i % 97 == 0).alias("error"), (i % 3 == 0).cast("int").alias("hit"))
    cand = e.select(i.alias("qid"), F.col("event_type").alias("kind"), (F.col("value") * 1.05).alias("latency"), F.lit(False).alias("degraded"), F.lit(False).alias("error"), ((i % 3 == 0) & (i % 7 != 0) | (i % 4 == 1)).cast("int").alias("hit"))
    return base, cand


@query(f"WITH {_RUNS} SELECT kind, round(avg(CASE WHEN NOT degraded AND NOT error THEN hit END), 6) AS quality, round(avg(latency), 6) AS latency, count(*) AS n, count(*) FILTER (WHERE degraded) AS degraded, count(*) FILTER (WHERE error) AS errors FROM b GROUP BY GROUPING SETS ((kind), ())")
def per_type_summary(spark, d):
    return E.summary(_runs(spark, d)[0], "kind")


_FB = "f AS (SELECT b.kind, count(*) FILTER (WHERE b.hit = 0 AND c.hit = 1) AS fixed, count(*) FILTER (WHERE b.hit = 1 AND c.hit = 0) AS broken, round(avg(c.hit - b.hit), 9) AS delta FROM b JOIN c USING (qid) GROUP BY b.kind)"


@query(f"WITH {_RUNS}, {_FB} SELECT * FROM f")
def fixed_broken(spark, d):
    return E.fixed_broken(*_runs(spark, d), "kind")


@query(f"""WITH {_RUNS}, {_FB}, p AS (SELECT (SELECT latency FROM (SELECT latency, row_number() OVER (ORDER BY latency) AS i, count(*) OVER () AS n FROM b) WHERE i = ceil(0.95::DOUBLE * n)) AS pb, (SELECT latency FROM (SELECT latency, row_number() OVER (ORDER BY latency) AS i, count(*) OVER () AS n FROM c) WHERE i = ceil(0.95::DOUBLE * n)) AS pc),
w AS (SELECT concat_ws(',', CASE WHEN (SELECT avg(hit) FROM c) <= (SELECT avg(hit) FROM b) THEN 'no_gain' END, CASE WHEN (SELECT min(delta) FROM f) < -0.02 THEN 'subgroup' END, CASE WHEN pc > 1.1::DOUBLE * pb THEN 'slower' END, CASE WHEN (SELECT count(*) FROM c WHERE degraded OR error) > 0 THEN 'degraded' END) AS reasons FROM p)
SELECT reasons, reasons = '' AS passed FROM w""")
def promotion_gate(spark, d):
    return E.promotion_gate(*_runs(spark, d), "kind")


@query(f"WITH {_RUNS}, x AS (SELECT qid, hit, latency FROM b), y AS (SELECT qid, hit, latency * CASE WHEN qid % 5 = 0 THEN 0.5 ELSE 1 END AS latency FROM c WHERE qid % 11 <> 0), z AS (SELECT x.qid, CASE WHEN y.qid IS NULL THEN 'omitted' WHEN x.hit = 1 AND y.hit = 0 THEN 'flipped' WHEN y.latency < x.latency THEN 'decreased' END AS what FROM x LEFT JOIN y USING (qid)) SELECT * FROM z WHERE what IS NOT NULL")
def regressions(spark, d):
    b, c = _runs(spark, d)
    before = b.select("qid", "hit", F.col("latency").alias("metric"))
    after = c.where("qid % 11 <> 0").select("qid", "hit", (F.col("latency") * F.when(F.col("qid") % 5 == 0, 0.5).otherwise(1)).alias("metric"))
    return E.regressions(before, after)


@query("""WITH s AS (SELECT lang, count(*) AS size, count(*) * 100 / CAST((SELECT count(*) FROM documents) AS DOUBLE) AS exact FROM documents GROUP BY lang),
b AS (SELECT lang, exact, CAST(floor(exact) AS BIGINT) AS base FROM s),
qt AS (SELECT lang, base + CASE WHEN row_number() OVER (ORDER BY round(exact - base, 9) DESC, lang) <= 100 - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM b),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY left(sha256('42:' || doc_id), 12), doc_id) AS k FROM documents)
SELECT doc_id, lang FROM r JOIN qt USING (lang) WHERE k <= quota""")
def strat_sample_hash(spark, d):
    return E.hash_sample(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang", 100)


# --- extensions: event time -------------------------------------------------------

@query("SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS VARCHAR) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ext_tumbling_window(spark, d):
    return S.tumbling(table(spark, d, "events")).withColumn("start", F.col("start").cast("string"))


@query("SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) - to_hours(k) AS VARCHAR) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, range(0, 2) t(k) GROUP BY ALL")
def ext_sliding_window(spark, d):
    return S.tumbling(table(spark, d, "events"), "2 hours", "1 hour").withColumn("start", F.col("start").cast("string"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS n FROM s GROUP BY user_id, k")
def ext_session_window(spark, d):
    return S.sessions(table(spark, d, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def ext_dedup(spark, d):
    e = table(spark, d, "events")
    return S.deduplicated(e.unionByName(e)).agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))
