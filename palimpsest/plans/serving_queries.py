"""Queries of the operators around retrieval: citations, batches, snapshots, sweeps, outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import access, bootstrap, lifecycle, serving
from palimpsest.plans.registry import query
from palimpsest.plans.retrieval_queries import ARMS, BASE, FUSED, _blended
from palimpsest.sources.tables import kb_pages, table

_CITES = "t AS (SELECT doc_id AS qid, ['d' || doc_id % 5, 'd' || doc_id % 3] AS cited, ['d' || doc_id % 4] AS must, ['d' || doc_id % 7] AS must_not, text AS answer, ['the', 'zzz'] AS forbidden FROM documents)"


@query(f"WITH {_CITES}, c AS (SELECT qid, CAST(len(list_filter(must, lambda x: NOT list_contains(cited, x))) AS INTEGER) AS missing, CAST(len(list_filter(must_not, lambda x: list_contains(cited, x))) AS INTEGER) AS wrong, contains(lower(answer), 'the') OR contains(lower(answer), 'zzz') AS leaked FROM t) SELECT *, missing = 0 AND wrong = 0 AND NOT leaked AS passed FROM c")
def citation_grading(spark, d):
    i = F.col("doc_id")
    tag = lambda n: F.concat(F.lit("d"), i % n)
    rows = table(spark, d, "documents").select(i.alias("qid"), F.array(tag(5), tag(3)).alias("cited"), F.array(tag(4)).alias("must"), F.array(tag(7)).alias("must_not"), F.col("text").alias("answer"), F.array(F.lit("the"), F.lit("zzz")).alias("forbidden"))
    return serving.grade_citations(rows)


@query("SELECT conv_id, turn, regexp_replace(regexp_replace('a[1] ' || regexp_replace(text, '[\\[\\]]', '', 'g') || '[' || turn || '] z[99]', CASE WHEN turn BETWEEN 1 AND 2 THEN 'QQQ' ELSE '\\[' || turn || '\\]' END, ''), '\\[99\\]', '') AS answer FROM conversations")
def marker_scrub(spark, d):
    text = F.concat(F.lit("a[1] "), F.regexp_replace("text", "[\\[\\]]", ""), F.lit("["), "turn", F.lit("] z[99]"))
    return table(spark, d, "conversations").select("conv_id", "turn", serving.scrub_markers(text, F.lit(2)).alias("answer"))


@query("SELECT l_orderkey AS chunk, CASE WHEN count(DISTINCT l_returnflag = 'N') = 1 THEN min(CASE WHEN l_returnflag = 'N' THEN 'page' ELSE 'sheet' END) END AS kind, CASE WHEN count(DISTINCT l_returnflag = 'N') = 1 THEN min(l_linenumber) END AS page_from, CASE WHEN count(DISTINCT l_returnflag = 'N') = 1 THEN max(l_linenumber + 1) END AS page_to FROM lineitem GROUP BY l_orderkey")
def locator_merge(spark, d):
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk"), F.when(F.col("l_returnflag") == "N", "page").otherwise("sheet").alias("kind"), F.col("l_linenumber").alias("page_from"), (F.col("l_linenumber") + 1).alias("page_to"))
    return serving.merge_locators(b, "chunk")


@query("SELECT l_orderkey AS page_id, string_agg(l_returnflag || l_partkey, chr(10) ORDER BY l_linenumber, l_returnflag || l_partkey) AS text, false AS truncated FROM lineitem GROUP BY l_orderkey")
def page_text(spark, d):
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("ord"), F.concat("l_returnflag", "l_partkey").alias("content"))
    return lifecycle.page_text(c)


@query("SELECT o_custkey AS qid, string_agg(k || '. ' || o_orderpriority || '#' || o_orderkey, chr(10) ORDER BY k) AS text FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k <= 8 GROUP BY o_custkey")
def top_snapshot(spark, d):
    return serving.snapshot(_top(spark, d))


def _top(spark, d):
    from pyspark.sql.window import Window as W

    o = table(spark, d, "orders").withColumn("rank", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))).where("rank <= 8")
    return o.select(F.col("o_custkey").alias("qid"), "rank", F.col("o_orderpriority").alias("slug"), F.col("o_orderkey").cast("int").alias("ord"))


@query("SELECT o_custkey AS qid, CAST(k AS INTEGER) AS rank, o_orderpriority AS slug, CAST(o_orderkey AS INTEGER) AS ord FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k <= 8")
def snapshot_reader(spark, d):
    return serving.read_snapshot(serving.snapshot(_top(spark, d)))


@query("SELECT c_custkey AS page_id, c_custkey % 3 <> 1 AS as_declared FROM customer")
def acl_expectation(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k.alias("page_id"), F.array(F.lit("ws:a"), F.lit("ws:b")).alias("acl"), F.when(k % 3 == 0, F.array(F.lit("ws:b"), F.lit("ws:a"))).when(k % 3 == 1, F.array(F.lit("ws:a"))).otherwise(F.array(F.lit("ws:a"), F.lit("ws:b"), F.lit("ws:a"))).alias("declared"))
    return serving.acl_as_declared(rows)


@query("SELECT 'c' || k AS config, count(*) AS missing FROM range(2, 6) t(k), benchmark WHERE item_id % k = 1 GROUP BY k")
def sweep_completeness(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"))
    configs = spark.range(2, 6).select(F.concat(F.lit("c"), "id").alias("config"), F.col("id").alias("k"))
    rows = q.crossJoin(F.broadcast(configs)).where("qid % k <> 1")  # four configurations
    return serving.completeness(rows, q, configs.select("config"))


_SHARES = "shares(name, s) AS (VALUES ('rrf', 1.0), ('default', 0.7), ('even', 0.5), ('cosine', 0.0))"


@query(f"""WITH {BASE} {ARMS} {FUSED} {_SHARES}, x AS (SELECT qid, chunk_id, rrf / max(rrf) OVER (PARTITION BY qid) AS nrrf, coalesce(1 - dist, 0) AS cos FROM capped c LEFT JOIN dist USING (qid, chunk_id)),
r AS (SELECT name, qid, chunk_id, row_number() OVER (PARTITION BY name, qid ORDER BY round(CAST(s AS DOUBLE) * nrrf + (1 - CAST(s AS DOUBLE)) * cos, 12) DESC, chunk_id) AS rank FROM x, shares) SELECT name, qid, chunk_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8""")
def policy_sweep(spark, d):
    from pyspark.sql.window import Window as W

    b = _blended(spark, d)
    scored = b.select("qid", "chunk_id", (F.col("rrf") / F.max("rrf").over(W.partitionBy("qid"))).alias("nrrf"), F.coalesce("cos", F.lit(0.0)).alias("cos"))
    shares = spark.createDataFrame([("rrf", 1.0), ("default", 0.7), ("even", 0.5), ("cosine", 0.0)], "name string, rrf_share double")
    return serving.sweep(scored, shares)


@query("""WITH f AS (SELECT doc_id AS seq, sha256(text) AS sha, CASE WHEN doc_id % 9 = 0 THEN 'too_short' ELSE 'ok' END AS verdict FROM documents),
m AS (SELECT sha, min(seq) AS first FROM f WHERE verdict = 'ok' GROUP BY sha), k AS (SELECT DISTINCT sha256(text) AS sha FROM documents WHERE doc_id % 50 = 3)
SELECT seq, CASE WHEN verdict <> 'ok' THEN 'rejected:' || verdict WHEN k.sha IS NOT NULL THEN 'duplicate' WHEN first < seq THEN 'duplicate_in_batch' ELSE 'ingested' END AS outcome FROM f LEFT JOIN m USING (sha) LEFT JOIN k ON k.sha = f.sha""")
def batch_ingest_outcomes(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.sha2("text", 256).alias("sha"), F.when(F.col("doc_id") % 9 == 0, "too_short").otherwise("ok").alias("verdict"))
    return serving.ingest_outcomes(t, t.where("seq % 50 = 3").select("sha"))


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 = 0 THEN 'free' WHEN n_nationkey % 5 = 1 THEN 'dead' WHEN n_nationkey * 5 > 60 THEN 'expired' ELSE 'live' END AS state FROM nation")
def lock_liveness(spark, d):
    k, now = F.col("n_nationkey"), F.to_timestamp(F.lit("2024-06-01 12:00:00"))
    beat = F.when(k % 5 == 1, F.lit(None)).otherwise(now - F.make_dt_interval(F.lit(0), F.lit(0), k * 5))
    return table(spark, d, "nation").select(k.alias("id"), serving.lock_state(beat, now, 60, k % 5 == 0).alias("state"))


@query("SELECT c_custkey AS id, c_custkey % 3 >= 1 AS may_admin, c_custkey % 3 = 2 AS may_own FROM customer")
def role_check(spark, d):
    role = F.element_at(F.array(F.lit("member"), F.lit("admin"), F.lit("owner")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), access.role_at_least(role, "admin").alias("may_admin"), access.role_at_least(role, "owner").alias("may_own"))


@query("SELECT slug, CASE WHEN count(p) = 1 THEN min(p) END AS page_id, CASE count(p) WHEN 0 THEN 'not_found' WHEN 1 THEN 'ok' ELSE 'ambiguous' END AS outcome FROM (SELECT 'n' || k AS slug FROM range(0, 30) t(k)) s LEFT JOIN (SELECT s_suppkey AS p, 'n' || s_nationkey AS v FROM supplier) ON slug = v GROUP BY slug")
def slug_resolution(spark, d):
    pages = table(spark, d, "supplier").select(F.col("s_suppkey").alias("page_id"), F.concat(F.lit("n"), "s_nationkey").alias("slug"))
    return lifecycle.resolve_slug(pages, spark.range(30).select(F.concat(F.lit("n"), "id").alias("slug")))


@query("WITH kb AS (SELECT doc_id AS page_id, doc_id % 7 AS owner, source AS workspace, CASE WHEN doc_id % 5 = 0 THEN ['self:u' || (doc_id % 7)] ELSE ['ws:' || source] END AS acl, CASE WHEN doc_id % 10 = 0 THEN 'private' ELSE 'shared' END AS scope FROM documents) SELECT page_id, scope FROM kb WHERE acl <> CASE WHEN scope = 'private' THEN ['self:u' || owner] ELSE ['ws:' || workspace] END")
def scope_agreement(spark, d):
    p = kb_pages(spark, d).withColumn("scope", F.when(F.col("page_id") % 10 == 0, "private").otherwise("shared"))
    return access.scope_agreement(p).select("page_id", "scope")


def _packing(rows: str, close: str) -> str:
    """SQL of a fold over rows (part, seq, tokens): close says when the next row opens a batch."""
    return f"""WITH RECURSIVE r AS ({rows}), i AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY seq) AS k FROM r),
    f(part, seq, k, batch, n, s) AS (SELECT part, seq, k, 0::BIGINT, 1::BIGINT, tokens FROM i WHERE k = 1
      UNION ALL SELECT i.part, i.seq, i.k, batch + CAST({close} AS BIGINT), CASE WHEN {close} THEN 1 ELSE n + 1 END, CASE WHEN {close} THEN tokens ELSE s + tokens END FROM f JOIN i ON i.part = f.part AND i.k = f.k + 1)
    SELECT part, seq, batch FROM f"""


@query(_packing("SELECT lang AS part, doc_id AS seq, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS tokens FROM documents", "(n >= 64 OR s + tokens > 20000)"))
def batch_planning(spark, d):
    """Which batch each item goes in: under 64 items and 20,000 tokens."""
    return serving.plan_batches(table(spark, d, "documents").select(F.col("lang").alias("part"), F.col("doc_id").alias("seq"), F.ceil(F.octet_length("text") / 4).alias("tokens")))


@query(_packing("SELECT CAST(p_size AS VARCHAR) AS part, p_partkey AS seq, coalesce((SELECT CAST(sum(l_quantity) AS BIGINT) FROM lineitem WHERE l_partkey = p_partkey), 0) AS tokens FROM part", "(s > 0 AND s + tokens > 2000)"))
def update_packing(spark, d):
    """Pages' rows packed into statements of 2,000 rows."""
    n = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").cast("long").alias("q"))
    p = table(spark, d, "part").join(n, "p_partkey", "left")
    return serving.plan_updates(p.select(F.col("p_size").cast("string").alias("part"), F.col("p_partkey").alias("seq"), F.coalesce("q", F.lit(0)).alias("tokens")))


@query("""WITH t AS (SELECT conv_id, turn, regexp_replace(text, '[\\[\\]]', '', 'g') || '[1] z[99]' AS raw FROM conversations)
SELECT conv_id, turn, CASE WHEN turn % 4 < 2 THEN replace(raw, '[99]', '') ELSE replace(CASE turn % 4 WHEN 2 THEN raw ELSE '{"answer": 5} ' || raw END, '[99]', '') END AS answer, CASE WHEN turn % 4 < 2 THEN '1,3' ELSE '' END AS citations, turn % 4 >= 2 AS degraded FROM t""")
def answer_parse(spark, d):
    """Responses as JSON, as JSON in a fence, as bare text, and as JSON that isn't an answer."""
    c = table(spark, d, "conversations").withColumn("raw", F.concat(F.regexp_replace("text", "[\\[\\]]", ""), F.lit("[1] z[99]")))
    body = F.to_json(F.struct(F.col("raw").alias("answer"), F.array(F.lit(1.0), F.lit(9.0), F.lit(1.5), F.lit(3.0), F.lit(1.0)).alias("citations")))
    said = F.when(F.col("turn") % 4 == 0, body).when(F.col("turn") % 4 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("turn") % 4 == 2, F.col("raw")).otherwise(F.concat(F.lit('{"answer": 5} '), "raw"))
    p = c.select("conv_id", "turn", serving.parse_answer(said, F.lit(4)).alias("p"))
    return p.select("conv_id", "turn", "p.answer", F.array_join(F.col("p.citations").cast("array<string>"), ",").alias("citations"), "p.degraded")


# The JSON is put together by hand and reasons are cut from the text: substr cuts bytes of what DuckDB's JSON functions return.
@query(r"""WITH q AS (SELECT conv_id, turn, text, '"' || replace(replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') || '"' AS s FROM conversations),
t AS (SELECT conv_id, turn, text, CASE turn % 5 WHEN 0 THEN '{"verdict":"correct","reason":' || s || '}' WHEN 1 THEN '```json' || chr(10) || '{"verdict":"partial","reason":' || s || '}' || chr(10) || '```' WHEN 2 THEN '{"verdict":"good","reason":' || s || '}' WHEN 3 THEN '{"verdict":"incorrect","reason":5}' ELSE text END AS raw FROM q),
b AS (SELECT *, regexp_replace(regexp_replace(raw, '^```json\s*', ''), '\n?```$', '') AS body FROM t), j AS (SELECT *, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS o FROM b),
v AS (SELECT *, coalesce(json_type(o, '$.verdict') = 'VARCHAR' AND json_extract_string(o, '$.verdict') IN ('correct', 'partial', 'incorrect'), false) AS good, coalesce(json_type(o, '$.reason') = 'VARCHAR', false) AS said FROM j)
SELECT conv_id, turn, CASE WHEN good THEN json_extract_string(o, '$.verdict') ELSE 'unparsed' END AS verdict, CASE WHEN NOT good THEN 'judge did not return valid JSON: ' || substr(raw, 1, 150) WHEN said THEN substr(text, 1, 200) ELSE '' END AS reason FROM v""")
def judge_verdicts(spark, d):
    """Responses as JSON, in a fence, with another verdict, with a number for a reason, and as bare text."""
    k = F.col("turn") % 5
    said = lambda verdict, reason: F.to_json(F.struct(F.lit(verdict).alias("verdict"), reason.alias("reason")))
    text = F.col("text")
    raw = F.when(k == 0, said("correct", text)).when(k == 1, F.concat(F.lit("```json\n"), said("partial", text), F.lit("\n```"))).when(k == 2, said("good", text)).when(k == 3, said("incorrect", F.lit(5))).otherwise(text)
    v = table(spark, d, "conversations").select("conv_id", "turn", serving.judge_verdict(raw).alias("v"))
    return v.select("conv_id", "turn", "v.verdict", "v.reason")


# Number k of the seeded stream (k from 0), by 32-bit arithmetic in 64 bits; a part's draw j of resample i is number i n + j.
_DRAWN = """w AS (SELECT part, item, delta, row_number() OVER (PARTITION BY part ORDER BY item) - 1 AS place, count(*) OVER (PARTITION BY part) AS n FROM deltas),
k AS (SELECT part, n, unnest(range(10000 * n)) AS k FROM (SELECT DISTINCT part, n FROM w)),
s AS (SELECT part, n, k, ((42 + (k + 1)::HUGEINT * 1831565813) % 4294967296)::UBIGINT AS s FROM k),
t AS (SELECT part, n, k, xor(s, s >> 15) * (s | 1::UBIGINT) % 4294967296 AS t FROM s),
u AS (SELECT part, n, k, xor(t, (t + xor(t, t >> 7) * (t | 61::UBIGINT) % 4294967296) % 4294967296) AS u FROM t),
dr AS (SELECT part, n, k // n AS resample, floor(xor(u, u >> 14)::DOUBLE / 4294967296 * n)::BIGINT AS place FROM u),
ms AS (SELECT part, resample, sum(delta)::DOUBLE / any_value(dr.n) AS mean FROM dr JOIN w USING (part, place) GROUP BY part, resample),
l AS (SELECT part, list_sort(list(mean)) AS m FROM ms GROUP BY part),
q AS (SELECT part, (SELECT sum(delta)::DOUBLE / count(*) FROM w WHERE w.part = l.part) AS mean, m[21] AS low, m[9980] AS high, least(1.0::DOUBLE, 2 * least(len(list_filter(m, lambda x: x <= 0)), len(list_filter(m, lambda x: x >= 0))) / 10000::DOUBLE) AS p FROM l),
r AS (SELECT *, least(1.0::DOUBLE, p * 12) AS adjusted_p FROM q)"""


@query(f"WITH deltas AS (SELECT 'all' AS part, item_id AS item, CAST(item_id % 3 = 0 AS INTEGER) - CAST(item_id % 7 = 0 AS INTEGER) AS delta FROM benchmark), {_DRAWN} SELECT mean, low, high, p, adjusted_p, low > 0 AND adjusted_p < 0.05 AS improves FROM r")
def bootstrap_gate(spark, d):
    """The paired bootstrap over one seeded stream: one difference for each item of the benchmark."""
    i = F.col("item_id")
    rows = table(spark, d, "benchmark").select(F.lit("all").alias("part"), i.alias("qid"), ((i % 3 == 0).cast("int") - (i % 7 == 0).cast("int")).alias("delta"))
    return bootstrap.paired(rows).select("mean", "low", "high", "p", "adjusted_p", "improves")


_SIDES = """sides AS (SELECT item_id AS item, 'kind:' || item_id % 4 AS kind, 'size:' || (length(text) > 400) AS size, CAST(item_id % 4 = 3 OR item_id % 7 = 0 AS INTEGER) AS b, CAST(item_id % 4 <> 3 AS INTEGER) AS c, length(text)::DOUBLE AS bl, length(text) * CASE WHEN item_id % 2 = 0 THEN 1.2::DOUBLE ELSE 1 END AS cl, item_id % 40 = 0 AS bad FROM benchmark),
deltas AS (SELECT 'all' AS part, item, c - b AS delta FROM sides UNION ALL SELECT kind, item, c - b FROM sides UNION ALL SELECT size, item, c - b FROM sides)"""


@query(f"""WITH {_SIDES}, {_DRAWN},
o AS (SELECT *, low > 0 AND adjusted_p < 0.05 AS improves FROM r WHERE part = 'all'), g AS (SELECT coalesce(string_agg(part, ',' ORDER BY part), '') AS regressing FROM r WHERE part <> 'all' AND high < 0 AND adjusted_p < 0.05),
x AS (SELECT count(*) FILTER (WHERE b = 0 AND c = 1) AS fixed, count(*) FILTER (WHERE b = 1 AND c = 0) AS broken, quantile_disc(cl, 0.95) / quantile_disc(bl, 0.95) AS latency_ratio, count(*) FILTER (WHERE bad) AS bad FROM sides),
f AS (SELECT concat_ws(',', CASE WHEN NOT improves THEN 'not_significant' END, CASE WHEN regressing <> '' THEN 'subgroup' END, CASE WHEN latency_ratio > 1.1::DOUBLE THEN 'slower' END, CASE WHEN bad > 0 THEN 'degraded' END) AS reasons, * FROM o, g, x)
SELECT reasons = '' AS passed, reasons, mean, low, high, p, adjusted_p, regressing, latency_ratio, fixed, broken FROM f""")
def significance_gate(spark, d):
    """A candidate that gains overall and loses one kind: bootstrap of all items and of each kind and size."""
    i = F.col("item_id")
    k = table(spark, d, "benchmark").withColumn("len", F.length("text").cast("double"))
    base = k.select(i.alias("qid"), (i % 4).alias("kind"), (F.col("len") > 400).alias("size"), ((i % 4 == 3) | (i % 7 == 0)).cast("int").alias("hit"), F.col("len").alias("latency"), (i % 40 == 0).alias("degraded"), F.lit(False).alias("error"))
    cand = k.select(i.alias("qid"), (i % 4 != 3).cast("int").alias("hit"), (F.col("len") * F.when(i % 2 == 0, 1.2).otherwise(1.0)).alias("latency"), F.lit(False).alias("degraded"), F.lit(False).alias("error"))
    return bootstrap.gate(base, cand, ["kind", "size"])
