"""Queries of censuses, drift, sessions, leaks, edits, and the evaluation's frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import access, audit, lifecycle
from palimpsest.operators import evaluation as E
from palimpsest.operators import retrieval as R
from palimpsest.plans.corpus_queries import GRANTS, PAGES
from palimpsest.plans.registry import query
from palimpsest.plans.retrieval_queries import BASE, SMALL
from palimpsest.sources.tables import chunks, kb_pages, questions, table


@query("""WITH p AS (SELECT o_orderkey AS page_id, o_orderstatus AS workspace, 'o-' || o_orderkey AS slug FROM orders), c AS (SELECT l_orderkey AS page_id, l_linestatus AS workspace FROM lineitem)
SELECT p.page_id, p.workspace, slug, count(c.page_id) AS chunks FROM p LEFT JOIN c ON c.page_id = p.page_id AND c.workspace = p.workspace GROUP BY ALL""")
def corpus_census(spark, d):
    p = table(spark, d, "orders").select(F.col("o_orderkey").alias("page_id"), F.col("o_orderstatus").alias("workspace"), F.concat(F.lit("o-"), "o_orderkey").alias("slug"))
    return audit.corpus_census(p, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_linestatus").alias("workspace")))


_FILES = "f AS (SELECT page_id, workspace AS ws, CASE WHEN page_id % 19 = 0 THEN ['ws:wide'] WHEN page_id % 23 = 0 THEN NULL ELSE acl END AS held FROM kb WHERE page_id % 2 = 0)"


@query(f"WITH {PAGES}, {_FILES} SELECT workspace, count(*) AS sources, count(*) FILTER (WHERE held IS DISTINCT FROM acl) AS drifted FROM f JOIN kb USING (page_id) GROUP BY workspace")
def source_drift(spark, d):
    """Stored files whose access list is not their page's; every second page has one."""
    p, i = kb_pages(spark, d), F.col("page_id")
    files = p.where("page_id % 2 = 0").select(i, F.when(i % 19 == 0, F.array(F.lit("ws:wide"))).when(i % 23 == 0, F.lit(None)).otherwise(F.col("acl")).alias("acl"))
    return access.drift(files, p).groupBy("workspace").agg(F.count("*").alias("sources"), F.count_if("drifted").alias("drifted"))


@query(f"""WITH {PAGES}, e AS (SELECT page_id AS f, (page_id * 7 + 3) % (SELECT count(*) FROM kb) AS t FROM kb),
l AS (SELECT CASE WHEN f % 13 = 0 THEN NULL ELSE a.acl END IS DISTINCT FROM a.acl AS x1, CASE WHEN f % 17 = 0 THEN ['ws:old'] ELSE b.acl END IS DISTINCT FROM b.acl AS x2, (a.deleted AND f % 3 > 0) IS DISTINCT FROM a.deleted AS x3, (b.deleted OR f % 29 = 0) IS DISTINCT FROM b.deleted AS x4 FROM e JOIN kb a ON a.page_id = f JOIN kb b ON b.page_id = t)
SELECT count(*) AS links, count(*) FILTER (WHERE x1) AS from_acl, count(*) FILTER (WHERE x2) AS to_acl, count(*) FILTER (WHERE x3) AS from_deleted, count(*) FILTER (WHERE x4) AS to_deleted, count(*) FILTER (WHERE x1 OR x2 OR x3 OR x4) AS drifted FROM l""")
def link_drift(spark, d):
    """The four copies of their pages' labels that links carry, some of them out of date."""
    p = kb_pages(spark, d).select("page_id", "acl", "deleted")
    n = F.broadcast(p.agg(F.count("*").alias("n")))  # one row
    to = p.select(F.col("page_id").alias("to_page_id"), F.col("acl").alias("ta"), F.col("deleted").alias("td"))
    f = F.col("page_id")
    e = p.crossJoin(n).withColumn("to_page_id", (f * 7 + 3) % F.col("n")).join(to, "to_page_id")
    e = e.select(f.alias("from_page_id"), "to_page_id", F.when(f % 13 == 0, F.lit(None)).otherwise(F.col("acl")).alias("from_acl"), F.when(f % 17 == 0, F.array(F.lit("ws:old"))).otherwise(F.col("ta")).alias("to_acl"), (F.col("deleted") & (f % 3 > 0)).alias("from_deleted"), (F.col("td") | (f % 29 == 0)).alias("to_deleted"))
    return audit.link_drift(e, p)


@query("""WITH s AS (SELECT o_orderkey AS session_id, o_custkey AS principal_id, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_custkey % 9 END AS workspace, o_orderkey % 4 AS epoch, o_orderdate AS expires_at FROM orders),
p AS (SELECT c_custkey AS principal_id, c_custkey % 4 AS epoch FROM customer), m AS (SELECT c_custkey AS principal_id, c_custkey % 9 AS workspace, c_mktsegment AS role FROM customer WHERE c_acctbal > 0),
j AS (SELECT s.*, s.expires_at <= TIMESTAMP '1995-01-01' AS late, s.epoch <> p.epoch AS old, m.workspace AS w, role FROM s JOIN p USING (principal_id) LEFT JOIN m ON m.principal_id = s.principal_id AND m.workspace = s.workspace)
SELECT session_id, CASE WHEN late THEN 'expired' WHEN old THEN 'epoch_stale' WHEN workspace IS NULL THEN 'no_active_ws' WHEN w IS NULL THEN 'membership_revoked' ELSE 'ok' END AS reason, CASE WHEN NOT late AND NOT old THEN principal_id END AS principal_id, CASE WHEN NOT late AND NOT old THEN w END AS workspace_id, CASE WHEN NOT late AND NOT old THEN role END AS role FROM j""")
def session_resolution(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    k, u = F.col("o_orderkey"), F.col("c_custkey")
    s = o.select(k.alias("session_id"), F.col("o_custkey").alias("principal_id"), F.when(k % 6 == 0, F.lit(None)).otherwise(F.col("o_custkey") % 9).alias("workspace"), (k % 4).alias("epoch"), F.col("o_orderdate").cast("timestamp").alias("expires_at"))
    m = c.where("c_acctbal > 0").select(u.alias("principal_id"), (u % 9).alias("workspace_id"), F.col("c_mktsegment").alias("role"))
    return audit.resolve_sessions(s, c.select(u.alias("principal_id"), (u % 4).alias("epoch")), m, F.to_timestamp(F.lit("1995-01-01 00:00:00")))


_BARE = BASE.strip().rstrip(",")


@query(f"""WITH {_BARE}, stale AS (SELECT chunk_id, CASE WHEN chunk_id % 3 = 0 THEN ['{SMALL[0]}'] ELSE acl END AS acl, deleted, tokens FROM every),
got AS (SELECT qid, chunk_id FROM stale, q WHERE list_has_any(acl, {list(SMALL)}) AND NOT deleted AND list_has_any(tokens, terms[1:32])),
barred AS (SELECT qid, chunk_id FROM every, q WHERE (deleted OR NOT list_has_any(acl, {list(SMALL)})) AND len(terms) > 0 AND list_has_all(tokens, terms))
SELECT qid, count(*) AS retrieved, count(b.chunk_id) AS leaked FROM got LEFT JOIN barred b USING (qid, chunk_id) GROUP BY qid""")
def leak_check(spark, d):
    """What a tenant of one workspace retrieves from chunks whose access lists are partly stale, held against each question's relevant chunks that the pages' lists bar."""
    c, q = chunks(spark, d), questions(spark, d)
    stale = c.withColumn("acl", F.when(F.col("chunk_id") % 3 == 0, F.array(F.lit(SMALL[0]))).otherwise(F.col("acl")))
    got = R.keyword_matches(q, access.visible(stale, SMALL)).select("qid", F.col("chunk_id").alias("slug"))
    relevant = R.keyword_matches(q, c).where("is_and").select("qid", "chunk_id")
    barred = relevant.join(access.visible(c, SMALL).select("chunk_id"), "chunk_id", "left_anti")
    return audit.leaks(got, barred.select("qid", F.col("chunk_id").alias("slug")))


@query(f"""WITH {PAGES}, e AS (SELECT doc_id * 3 AS id, CASE WHEN doc_id % 8 = 0 THEN ' ' ELSE 'new ' || text END AS t FROM documents), g AS (SELECT DISTINCT doc_id * 14 AS page_id, true AS filed FROM documents)
SELECT id, CASE WHEN kb.page_id IS NULL OR deleted OR NOT list_has_any(acl, ['self:u3', 'ws:src1', 'ws:src2']) THEN 'not_visible' WHEN owner <> 3 THEN 'not_author' WHEN id IN (SELECT page_id + 3 FROM g) THEN 'has_source' WHEN trim(t) = '' THEN 'no_text' ELSE 'ok' END AS outcome FROM e LEFT JOIN kb ON page_id = id""")
def replace_outcomes(spark, d):
    return lifecycle.replace_outcomes(kb_pages(spark, d), *_edits(spark, d), GRANTS, 3)


def _edits(spark, d):
    t, i = table(spark, d, "documents"), F.col("doc_id")
    edits = t.select((i * 3).alias("id"), F.when(i % 8 == 0, " ").otherwise(F.concat(F.lit("new "), "text")).alias("body"), F.when(i % 2 == 0, F.concat(F.lit("title "), i)).alias("title"))
    return edits, t.select((i * 14 + 3).alias("page_id"))


@query(f"""WITH {PAGES}, e AS (SELECT doc_id * 3 AS id, doc_id, CASE WHEN doc_id % 8 = 0 THEN ' ' ELSE 'new ' || text END AS t FROM documents), ok AS (SELECT id, t, CASE WHEN doc_id % 2 = 0 THEN 'title ' || doc_id END AS title2 FROM e JOIN kb ON page_id = id WHERE NOT deleted AND list_has_any(acl, ['self:u3', 'ws:src1', 'ws:src2']) AND owner = 3 AND id NOT IN (SELECT doc_id * 14 + 3 FROM documents) AND trim(t) <> '')
SELECT page_id, sha256(coalesce(t, body)) AS content_hash, coalesce(title2, title) AS title, id IS NOT NULL AS changed FROM kb LEFT JOIN ok ON id = page_id""")
def replaced_bodies(spark, d):
    """All pages after the edits."""
    p = kb_pages(spark, d).select("page_id", "title", "owner", "acl", "slug", "deleted", "body", F.sha2("body", 256).alias("content_hash"), F.lit("before").alias("updated_at"))
    edits, sources = _edits(spark, d)
    out = lifecycle.replaced_pages(p, edits, lifecycle.replace_outcomes(p, edits, sources, GRANTS, 3), F.lit("now"))
    return out.select("page_id", "content_hash", "title", (F.col("updated_at") == "now").alias("changed"))


@query("SELECT lang, min(n_chars) AS least, max(m) AS median, max(n_chars) AS greatest, count(*) AS n FROM (SELECT lang, n_chars, CASE WHEN row_number() OVER w = floor(count(*) OVER (PARTITION BY lang) / 2) + 1 THEN n_chars END AS m FROM documents WINDOW w AS (PARTITION BY lang ORDER BY n_chars)) GROUP BY lang")
def timing_summary(spark, d):
    """Least, upper median and greatest length by language."""
    return E.timings(table(spark, d, "documents"), "lang", "n_chars")


@query("""WITH q AS (SELECT doc_id AS qid, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE lang END AS type, CAST(doc_id % 3 AS INTEGER) AS hops FROM documents), g AS (SELECT *, coalesce(type, 'untyped') || chr(0) || hops AS g FROM q),
s AS (SELECT g, count(*) AS size, count(*) * 0.7::DOUBLE AS exact FROM g GROUP BY g), u AS (SELECT g, CAST(floor(exact) AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY round(exact - floor(exact), 9) DESC, g) <= floor((SELECT count(*) FROM q) * 0.7::DOUBLE + 0.5) - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS quota FROM s)
SELECT qid, type, hops, CASE WHEN row_number() OVER (PARTITION BY g.g ORDER BY left(sha256('42:' || qid), 12), qid) <= quota THEN 'tuning' ELSE 'holdout' END AS side FROM g JOIN u ON u.g = g.g""")
def joint_split(spark, d):
    i = F.col("doc_id")
    return E.joint_split(table(spark, d, "documents").select(i.alias("qid"), F.when(i % 10 != 0, F.col("lang")).alias("type"), (i % 3).cast("int").alias("hops")))


@query("""WITH b AS (SELECT event_id AS qid, k, CASE WHEN event_id % 31 = 0 THEN NULL ELSE round(least(1, (event_id % 5 + 1) * k / 60.0::DOUBLE), 6) END AS recall, CAST(k - event_id % (k // 2 + 1) AS BIGINT) AS docs FROM events, (VALUES (4), (8), (12), (16), (20)) t(k)),
h AS (SELECT qid, recall, docs, greatest(0, (8 - docs) // 2) AS more FROM b WHERE k = 8 AND recall IS NOT NULL),
x AS (SELECT h.*, (SELECT arg_min(b.recall, b.k) FROM b WHERE b.qid = h.qid AND b.k >= 8 + h.more AND b.recall IS NOT NULL) AS best FROM h)
SELECT round(avg(recall), 9) AS baseline, round(avg(coalesce(best, recall)), 9) AS bound, count(*) AS n, round(avg(docs), 9) AS mean_docs, round(avg(docs + more), 9) AS ceiling_docs FROM x""")
def cap_bound(spark, d):
    """What a cap of two places a page could reach at most, from lists made under a cap of three."""
    i, k = F.col("event_id"), F.col("k")
    rows = table(spark, d, "events").select(i, F.explode(F.array(*map(F.lit, (4, 8, 12, 16, 20)))).alias("k"))
    rows = rows.select(i.alias("qid"), "k", F.when(i % 31 != 0, F.round(F.least(F.lit(1.0), (i % 5 + 1) * k / 60.0), 6)).alias("recall"), (k - i % (F.floor(k / 2) + 1)).alias("docs"))
    return E.cap_bound(rows, 8, 2)


@query("""WITH r AS (SELECT item_id AS qid, item_id % 11 = 0 AS example, CASE WHEN item_id % 3 = 0 THEN NULL ELSE item_id % 5 = 0 END AS abstains, CASE WHEN item_id % 2 = 0 THEN NULL WHEN item_id % 25 = 0 THEN [] ELSE ['p' || item_id] END AS relevant, CASE WHEN item_id % 4 = 0 THEN 'answer-string' ELSE 'pages' END AS output, item_id % 8 = 0 AS expects FROM benchmark)
SELECT qid, CASE WHEN example THEN 'example' WHEN abstains AND len(relevant) > 0 THEN 'invalid' WHEN abstains THEN 'abstention' WHEN relevant IS NULL AND output = 'answer-string' AND expects THEN 'answer_only' ELSE 'candidate' END AS kind FROM r""")
def gold_partition(spark, d):
    i = F.col("item_id")
    rows = table(spark, d, "benchmark").select(i.alias("qid"), (i % 11 == 0).alias("example"), F.when(i % 3 != 0, i % 5 == 0).alias("abstains"), F.when(i % 2 == 0, F.lit(None)).when(i % 25 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("p"), i))).alias("relevant"), F.when(i % 4 == 0, "answer-string").otherwise("pages").alias("output"), (i % 8 == 0).alias("expects"))
    return E.gold_partition(rows)


@query("SELECT conv_id, turn, regexp_replace(regexp_replace(replace(text || chr(7) || chr(13) || 'x' || conv_id, 'x' || conv_id, repeat('*', length('x' || conv_id))), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{9f}\\x{2028}\\x{2029}]', ' ', 'g'), '\\r\\n?', chr(10), 'g') AS framed FROM conversations")
def frame_text(spark, d):
    """Turns as they may stand in a frame whose mark is known."""
    nonce = F.concat(F.lit("x"), "conv_id")
    return table(spark, d, "conversations").select("conv_id", "turn", T.without_hazards(F.concat("text", F.lit("\x07\r"), nonce), nonce).alias("framed"))


@query("SELECT page_id, CASE WHEN s = '' THEN left(sha256(b), 12) WHEN length(s) > 200 THEN left(s, 187) || '-' || left(sha256(b), 12) ELSE s END AS slug FROM (SELECT page_id, b, regexp_replace(regexp_replace(lower(regexp_replace(b, '^www\\.', '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM (SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\\.[A-Za-z0-9]+$', '\\1') AS b FROM pages))")
def file_slug(spark, d):
    return table(spark, d, "pages").select("page_id", T.slug_of_file(F.col("url")).alias("slug"))
