"""Retrieval queries over documents, benchmark and embeddings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import intent as I
from palimpsest.operators import retrieval as R
from palimpsest.operators.access import visible
from palimpsest.plans.policy import DEFAULT
from palimpsest.plans.registry import query
from palimpsest.sources.shared import folder, stored
from palimpsest.sources.tables import chunks, questions, table

#: The one who asks may read these; ``SMALL`` is a tenant of a single workspace.
KEYRING = ("self:u3", *(f"ws:src{i}" for i in range(14)))
SMALL = ("ws:src1",)


def _readable(spark: SparkSession, d: str, keyring: tuple[str, ...] = KEYRING) -> DataFrame:
    """The chunks that a keyring may read; nothing else reaches an arm."""
    return visible(chunks(spark, d), keyring)


_TERMS = """list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: x <> '')"""
BASE = f"""
every AS (SELECT doc_id AS chunk_id, doc_id // 4 AS page_id, text AS content, string_split(text, chr(10))[1] AS title, {_TERMS.format('text')} AS tokens,
          CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS DATE) AS effective_date, 'Author-' || (doc_id % 7) AS author, doc_id % 11 = 0 AS deleted, CASE WHEN doc_id % 5 = 0 THEN ['self:u' || (doc_id % 7)] ELSE ['ws:' || source] END AS acl FROM documents),
 tok AS (SELECT * FROM every WHERE NOT deleted AND list_has_any(acl, {list(KEYRING)})),
q0 AS (SELECT item_id AS qid, text AS question, list_filter({_TERMS.format('text')}, lambda x: length(x) >= 3) AS t FROM benchmark),
q AS (SELECT qid, question, list_filter(t, lambda x, i: list_position(t, x) = i) AS terms FROM q0),
qt AS (SELECT qid, len(terms) AS n, unnest(terms) AS term, generate_subscripts(terms, 1) <= 32 AS early FROM q),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(tokens) AS term FROM tok) GROUP BY ALL),
kw AS (SELECT qid, chunk_id, count(*) FILTER (WHERE early) AS matched, CAST(sum(tf) FILTER (WHERE early) AS BIGINT) AS positions, count(*) = max(n) AS is_and FROM tf JOIN qt USING (term) GROUP BY qid, chunk_id HAVING bool_or(early)),
kwr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, is_and ORDER BY positions DESC, chunk_id) AS rk FROM kw) WHERE rk <= CASE WHEN is_and THEN 20 ELSE 10 END),
ttf AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest({_TERMS.format('title')}) AS term FROM tok) GROUP BY ALL),
tw AS (SELECT qid, chunk_id, CAST(sum(tf) AS BIGINT) AS hits FROM ttf JOIN qt USING (term) WHERE early GROUP BY ALL),
tr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hits DESC, chunk_id) AS rk FROM tw) WHERE rk <= 10),
vecs AS (SELECT vec_id AS chunk_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings SEMI JOIN tok ON vec_id = chunk_id),
qv AS (SELECT item_id AS qid, CAST(embedding AS DOUBLE[]) AS qvec FROM benchmark JOIN embeddings ON vec_id = item_id),
dist AS (SELECT qid, chunk_id, 1 - list_cosine_similarity(qvec, vec) AS dist FROM qv, vecs),
vr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(dist, 12), chunk_id) AS rk FROM dist) WHERE rk <= 20),
""".strip()
ARMS = """
arms AS (SELECT qid, chunk_id, rk, CASE WHEN is_and THEN 1.0 ELSE 0.4 END AS w, 60.0 AS k FROM kwr
         UNION ALL SELECT qid, chunk_id, rk, 1.0, 60.0 FROM vr UNION ALL SELECT qid, chunk_id, rk, 0.5, 60.0 FROM tr),
""".strip()
FUSED = """
fused AS (SELECT qid, chunk_id, sum(CAST(w AS DOUBLE) / (CAST(k AS DOUBLE) + rk - 1)) AS rrf FROM arms GROUP BY ALL),
capped AS (SELECT * FROM (SELECT f.*, page_id, row_number() OVER (PARTITION BY qid, page_id ORDER BY round(rrf, 12) DESC, chunk_id) AS p FROM fused f JOIN tok USING (chunk_id)) WHERE p <= 2),
blended AS (SELECT c.*, 0.7 * rrf / max(rrf) OVER (PARTITION BY qid) + 0.3 * coalesce(1 - dist, 0) AS score FROM capped c LEFT JOIN dist USING (qid, chunk_id)),
""".strip()


def _sql(body: str, *more: str) -> str:
    return f"WITH {BASE} {' '.join(more)} last AS (SELECT 1) {body}"


def _queries(spark: SparkSession, d: str) -> DataFrame:
    """(qid, qvec): the vector with the item's number."""
    e = table(spark, d, "embeddings")
    return questions(spark, d).select("qid").join(e, F.col("qid") == F.col("vec_id")).select("qid", F.col("embedding").alias("qvec"))


def _vectors(spark: SparkSession, d: str, keyring: tuple[str, ...] = KEYRING) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    return e.join(_readable(spark, d, keyring).select("chunk_id"), "chunk_id", "left_semi")


def _arms(spark: SparkSession, d: str, keyring: tuple[str, ...] = KEYRING) -> tuple[DataFrame, DataFrame, DataFrame]:
    q, c = questions(spark, d), _readable(spark, d, keyring)
    p = DEFAULT
    return (R.keyword_arms(R.keyword_matches(q, c, p.max_terms, max(p.keyword_and, p.keyword_or)), p.keyword_and, p.keyword_or), R.vector_arm(_queries(spark, d), _vectors(spark, d, keyring), p.vector), R.title_arm(q, c, p.title))


def _weight(is_and) -> F.Column:
    return F.when(is_and, DEFAULT.weight_keyword_and).otherwise(DEFAULT.weight_keyword_or)


def _fused(spark: SparkSession, d: str, keyring: tuple[str, ...] = KEYRING) -> DataFrame:
    kw, vec, title = _arms(spark, d, keyring)
    p = DEFAULT
    return R.fuse([(kw, _weight(F.col("is_and")), p.rrf_k), (vec, p.weight_vector, p.rrf_k), (title, p.weight_title, p.rrf_k)])


def _blended(spark: SparkSession, d: str, keyring: tuple[str, ...] = KEYRING) -> DataFrame:
    c = chunks(spark, d)
    capped = R.page_cap(_fused(spark, d, keyring), c.select("chunk_id", "page_id"), DEFAULT.max_per_page)
    capped = stored(capped, folder(spark))  # few rows a question, which are read twice
    pairs = capped.select("qid", "chunk_id").join(_queries(spark, d), "qid").join(_vectors(spark, d, keyring), "chunk_id")
    return R.blend(capped, pairs.select("qid", "chunk_id", R.cosine(F.col("qvec"), F.col("vec")).alias("cos")), DEFAULT.rrf_share)


@query(_sql("SELECT qid, chunk_id, matched, positions FROM kw"))
def kw_or_match(spark, d):
    return R.keyword_matches(questions(spark, d), _readable(spark, d)).select("qid", "chunk_id", "matched", "positions")


@query(_sql("SELECT qid, chunk_id, positions FROM kw WHERE is_and"))
def kw_and_tier(spark, d):
    return R.keyword_matches(questions(spark, d), _readable(spark, d)).where("is_and").select("qid", "chunk_id", "positions")


@query(_sql("SELECT qid, chunk_id, is_and, round(positions * CAST(0.1 AS DOUBLE), 6) AS rank, CAST(rk AS INTEGER) AS rk FROM kwr"))
def kw_rank_split(spark, d):
    return R.keyword_arms(R.keyword_matches(questions(spark, d), _readable(spark, d), best=20))


@query(_sql("SELECT qid, chunk_id, round(dist, 6) AS dist, CAST(rk AS INTEGER) AS rk FROM vr"))
def vec_topk(spark, d):
    return R.vector_arm(_queries(spark, d), _vectors(spark, d)).select("qid", "chunk_id", F.round("dist", 6).alias("dist"), "rk")


@query(_sql("SELECT c.chunk_id, v.vec IS NOT NULL AS has_vector, round(coalesce(list_cosine_similarity(v.vec, (SELECT qvec FROM qv WHERE qid = 1)), 0), 6) AS cos FROM tok c LEFT JOIN vecs v USING (chunk_id)"))
def null_vector_path(spark, d):
    one = _queries(spark, d).where("qid = 1").select("qvec")  # a single row
    j = _readable(spark, d).select("chunk_id").join(_vectors(spark, d), "chunk_id", "left").crossJoin(F.broadcast(one))
    return j.select("chunk_id", F.col("vec").isNotNull().alias("has_vector"), F.round(F.coalesce(R.cosine(F.col("vec"), F.col("qvec")), F.lit(0.0)), 6).alias("cos"))


@query(_sql("SELECT qid, chunk_id, hits, CAST(rk AS INTEGER) AS rk FROM tr"))
def title_arm(spark, d):
    return R.title_arm(questions(spark, d), _readable(spark, d))


@query(_sql("SELECT qid, chunk_id, round(rrf, 9) AS rrf FROM fused", ARMS, FUSED))
def rrf_fuse(spark, d):
    return _fused(spark, d).select("qid", "chunk_id", F.round("rrf", 9).alias("rrf"))


_INTENT_ARMS = """
iw(i, kwt, vwt) AS (VALUES (0, 1.15, 1.0), (1, 1.0, 1.0), (2, 1.2, 0.95), (3, 0.9, 1.2)),
arms AS (SELECT qid, chunk_id, rk, CASE WHEN is_and THEN 1.0 ELSE 0.4 END AS w, 60 / CAST(kwt AS DOUBLE) AS k FROM kwr JOIN iw ON qid % 4 = i
         UNION ALL SELECT qid, chunk_id, rk, 1.0, 60 / CAST(vwt AS DOUBLE) FROM vr JOIN iw ON qid % 4 = i
         UNION ALL SELECT qid, chunk_id, rk, 0.5, 60 / CAST(kwt AS DOUBLE) FROM tr JOIN iw ON qid % 4 = i),
"""


@query(_sql("SELECT qid, chunk_id, round(rrf, 9) AS rrf FROM fused", _INTENT_ARMS, FUSED))
def rrf_intent_k(spark, d):
    """Each list's k is 60 over its intent weight; questions take the four weighted intents in turn."""
    kw, vec, title = _arms(spark, d)
    names = ["entity", "temporal", "event", "concept"]
    pick = lambda k: F.element_at(F.array(*[F.lit(I.INTENT_WEIGHTS[n][k]) for n in names]), (F.col("qid") % 4 + 1).cast("int"))
    kk, vk = 60 / pick(0), 60 / pick(1)
    return R.fuse([(kw, _weight(F.col("is_and")), kk), (vec, 1.0, vk), (title, 0.5, kk)]).select("qid", "chunk_id", F.round("rrf", 9).alias("rrf"))


@query(_sql("""SELECT qid, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, chunk_id) AS rank FROM
  (SELECT * FROM (SELECT b.*, row_number() OVER (PARTITION BY qid, md5(content) ORDER BY round(score, 12) DESC, chunk_id) AS dup FROM blended b JOIN tok USING (chunk_id)) WHERE dup = 1)) WHERE rank <= 8""", ARMS, FUSED))
def blend_dedup(spark, d):
    hashes = chunks(spark, d).select("chunk_id", F.md5("content").alias("hash"))
    return R.top(R.collapse(_blended(spark, d), hashes), DEFAULT.top_k).select("qid", "chunk_id", F.round("score", 6).alias("score"), "rank")


def _hybrid(spark: SparkSession, d: str, keyring: tuple[str, ...] = KEYRING) -> DataFrame:
    """Everything: fusion, cap, blend, intent boost, recency, collapse, top."""
    q = questions(spark, d).select("qid", "question", I.intent(F.col("question")).alias("intent"), I.recency_hint(F.col("question")).alias("hint"))
    c = chunks(spark, d).select("chunk_id", "title", "effective_date", F.md5("content").alias("hash"))
    wide = _blended(spark, d, keyring).join(q, "qid").join(c, "chunk_id")
    slug = F.concat(F.lit("doc-"), F.col("chunk_id"))
    boost = F.when(R.exact_match(slug, F.col("title"), F.col("question")), 1.25).otherwise(1.0)
    mode = F.when(F.col("qid") % 3 == 0, "on").when(F.col("qid") % 3 == 1, "strong").otherwise(F.col("hint"))
    factor = R.recency_factor(F.col("effective_date"), F.to_date(F.lit("2024-12-31")), mode)
    scored = wide.withColumn("score", F.col("score") * boost * factor)
    best = R.collapse(scored.drop("hash", "title"), c.select("chunk_id", "hash"))
    return R.top(best, DEFAULT.top_k)


_HINT = f"CASE WHEN regexp_matches(question, '{I.sql_pattern(I.CANONICAL)}') AND NOT regexp_matches(question, '{I.sql_pattern(I.TIME_BOUND)}') THEN 'off' WHEN regexp_matches(question, '{I.sql_pattern(I.STRONG_RECENCY)}') THEN 'strong' WHEN regexp_matches(question, '{I.sql_pattern(I.RECENCY_ON)}') THEN 'on' ELSE 'off' END"
_FACTOR = "CASE WHEN mode IN ('on', 'strong') THEN 1 + CASE WHEN mode = 'strong' THEN 1.5::DOUBLE ELSE 1 END * 0.3::DOUBLE * 90 / (90 + greatest(0, date_diff('day', effective_date, DATE '2024-12-31'))) ELSE 1 END"
_KEBAB = r"regexp_replace(lower({0}), '\s+', '-', 'g')"
_HYBRID = f"""
qm AS (SELECT qid, question, CASE qid % 3 WHEN 0 THEN 'on' WHEN 1 THEN 'strong' ELSE {_HINT} END AS mode FROM q),
adj AS (SELECT b.qid, b.chunk_id, b.page_id, md5(content) AS h, score * ({_FACTOR}) * CASE WHEN 'doc-' || chunk_id = {_KEBAB.format('trim(question)')} OR lower(trim(title)) = lower(trim(question)) THEN 1.25::DOUBLE ELSE 1 END AS score
        FROM blended b JOIN qm USING (qid) JOIN tok t USING (chunk_id)),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, h ORDER BY round(score, 12) DESC, chunk_id) AS dup FROM adj) WHERE dup = 1),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, chunk_id) AS rank FROM one) WHERE rank <= 8),
"""


@query(_sql("SELECT qid, chunk_id, page_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM best", ARMS, FUSED, _HYBRID))
def hybrid_rrf(spark, d):
    return _hybrid(spark, d).select("qid", "chunk_id", "page_id", F.round("score", 6).alias("score"), "rank")


@query(_sql("SELECT qid, chunk_id, page_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM best", ARMS, FUSED, _HYBRID).replace(str(list(KEYRING)), str(list(SMALL))))
def hybrid_small_tenant(spark, d):
    """A tenant with one workspace among many still gets full lists: its rows are picked before any ranking."""
    return _hybrid(spark, d, SMALL).select("qid", "chunk_id", "page_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH t AS (SELECT doc_id, 'doc-' || doc_id AS slug, string_split(text, chr(10))[1] AS title FROM documents),
a AS (SELECT doc_id, slug, title, CASE doc_id % 5 WHEN 0 THEN 'Doc  ' || doc_id WHEN 1 THEN title WHEN 2 THEN ' ' || upper(slug) WHEN 3 THEN 'Doc: ' || doc_id ELSE 'notes/doc ' || doc_id END AS question FROM t)
SELECT doc_id, lower(trim(question)) = slug OR {_KEBAB.format('trim(question)')} = slug OR ends_with(slug, '/' || {_KEBAB.format('trim(question)')}) OR lower(trim(title)) = lower(trim(question)) AS exact FROM a""")
def exact_boost(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc-"), "doc_id").alias("slug"), F.substring_index("text", "\n", 1).alias("title"))
    k = F.col("doc_id") % 5
    asked = F.when(k == 0, F.concat(F.lit("Doc  "), "doc_id")).when(k == 1, F.col("title")).when(k == 2, F.concat(F.lit(" "), F.upper("slug"))).when(k == 3, F.concat(F.lit("Doc: "), "doc_id")).otherwise(F.concat(F.lit("notes/doc "), "doc_id"))
    return t.select("doc_id", R.exact_match(F.col("slug"), F.col("title"), asked).alias("exact"))


@query(f"""WITH t AS (SELECT doc_id, CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS DATE) AS effective_date, CASE doc_id % 3 WHEN 0 THEN 'off' WHEN 1 THEN 'on' ELSE 'strong' END AS mode FROM documents)
SELECT doc_id, round({_FACTOR}, 9) AS factor FROM t""")
def recency_factor(spark, d):
    mode = F.element_at(F.array(F.lit("off"), F.lit("on"), F.lit("strong")), (F.col("chunk_id") % 3 + 1).cast("int"))
    return chunks(spark, d).select(F.col("chunk_id").alias("doc_id"), F.round(R.recency_factor(F.col("effective_date"), F.to_date(F.lit("2024-12-31")), mode), 9).alias("factor"))


@query(_sql("SELECT chunk_id, CAST(effective_date AS VARCHAR) AS effective_date, author FROM tok WHERE effective_date >= DATE '2024-03-01' AND effective_date <= DATE '2024-09-30' AND lower(trim(author)) = 'author-3'"))
def metadata_filter(spark, d):
    return R.metadata_filter(_readable(spark, d).select("chunk_id", "effective_date", "author"), "2024-03-01", "2024-09-30", " AUTHOR-3 ").withColumn("effective_date", F.col("effective_date").cast("string"))


@query(_sql("SELECT qid, chunk_id, round(score, 6) AS score FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS m FROM best) WHERE round(score, 12) >= round(0.8::DOUBLE * m, 12)", ARMS, FUSED, _HYBRID))
def autocut(spark, d):
    return R.autocut(_hybrid(spark, d), 0.8).select("qid", "chunk_id", F.round("score", 6).alias("score"))


_EDGES = """
e AS (SELECT doc_id AS from_page_id, (doc_id * 7 + 3) % (SELECT count(*) FROM documents) AS to_page_id, doc_id % 50 AS created_at FROM documents
      UNION ALL SELECT doc_id, (doc_id * 13 + 5) % (SELECT count(*) FROM documents), (doc_id * 3) % 50 FROM documents),
seeds AS (SELECT qid, chunk_id AS page_id FROM kwr UNION SELECT qid, chunk_id FROM vr UNION SELECT qid, chunk_id FROM tr),
hop AS (SELECT s.qid, s.page_id AS seed, to_page_id AS page_id, created_at FROM seeds s JOIN e ON from_page_id = s.page_id
        UNION ALL SELECT s.qid, s.page_id, from_page_id, created_at FROM seeds s JOIN e ON to_page_id = s.page_id),
near AS (SELECT qid, seed, page_id, min(created_at) AS first FROM hop h ANTI JOIN seeds s USING (qid, page_id) GROUP BY ALL),
n3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, seed ORDER BY first, page_id) AS n FROM near) WHERE n <= 3),
nb AS (SELECT qid, page_id, min(n) AS seed_rk, min(first) AS first FROM n3 GROUP BY ALL),
"""


@query(_sql("SELECT qid, page_id AS chunk_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY seed_rk, first, page_id) AS INTEGER) AS rk FROM nb SEMI JOIN documents ON doc_id = page_id", _EDGES))
def graph_expand(spark, d):
    """Seeds are the pages of every arm."""
    seeds = reduce(DataFrame.union, (a.select("qid", F.col("chunk_id").alias("page_id")) for a in _arms(spark, d))).distinct()
    seeds = stored(seeds, folder(spark))  # read from both ends of a link, and to leave seeds out
    pages = chunks(spark, d).select("chunk_id", F.col("chunk_id").alias("page_id"))
    return R.graph_arm(seeds, edges(spark, d), pages).select("qid", "chunk_id", "rk")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Two synthetic links from each page."""
    t = table(spark, d, "documents").select("doc_id")
    n = t.agg(F.count("*").alias("n"))
    t = t.crossJoin(F.broadcast(n))  # one row
    one = t.select(F.col("doc_id").alias("from_page_id"), ((F.col("doc_id") * 7 + 3) % F.col("n")).alias("to_page_id"), (F.col("doc_id") % 50).alias("created_at"))
    return one.unionByName(t.select(F.col("doc_id").alias("from_page_id"), ((F.col("doc_id") * 13 + 5) % F.col("n")).alias("to_page_id"), ((F.col("doc_id") * 3) % 50).alias("created_at")))


_ASKED = """WITH x(k, s) AS (VALUES (0, 'When did we last meet '), (1, 'Tell me everything about '), (2, 'Who is '), (3, 'Was the launch announced for '), (4, 'find all pages that mention '), (5, 'notes on the shape of '), (6, 'What''s happening today with '), (7, 'status update on '), (8, 'define '), (9, '')),
t AS (SELECT conv_id, turn, s || text AS question FROM conversations JOIN x ON (conv_id * 3 + turn) % 10 = k)"""
_PRE = ["When did we last meet ", "Tell me everything about ", "Who is ", "Was the launch announced for ", "find all pages that mention ", "notes on the shape of ", "What's happening today with ", "status update on ", "define ", ""]


def _asked(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    pre = F.element_at(F.array(*[F.lit(p) for p in _PRE]), ((F.col("conv_id") * 3 + F.col("turn")) % 10 + 1).cast("int"))
    return c.select("conv_id", "turn", F.concat(pre, "text").alias("question"))


def _m(name: list[str], col: str = "question") -> str:
    return f"regexp_matches({col}, '{I.sql_pattern(name)}')"


_T = "trim(question)"
_CONCEPT = rf"""(len(regexp_split_to_array({_T}, '[ \t\n\r]+')) >= 3 AND ({_m(I.CONCEPT_CUE, _T)} OR {_m(I.CONCEPT_ASKED, _T)}) AND NOT {_m(I.CONCEPT_NOT, _T)}
 AND NOT regexp_matches({_T}, '[^ \t\n\r.!?:;•\-(\["“][ \t\n\r]+\p{{Lu}}') AND NOT ({_m(I.CONCEPT_ASKED, _T)} AND NOT {_m(I.CONCEPT_CUE, _T)} AND {_m(I.CONCEPT_STATUS, _T)}))"""


@query(f"{_ASKED} SELECT conv_id, turn, CASE WHEN {_m(I.FULL_CONTEXT)} OR {_m(I.TEMPORAL)} THEN 'temporal' WHEN {_m(I.EVENT)} THEN 'event' WHEN {_CONCEPT} THEN 'concept' WHEN {_m(I.ENTITY)} THEN 'entity' ELSE 'general' END AS intent FROM t")
def intent_class(spark, d):
    return _asked(spark, d).select("conv_id", "turn", I.intent(F.col("question")).alias("intent"))


@query(f"{_ASKED} SELECT conv_id, turn, {_m(I.CANONICAL)} AND NOT {_m(I.TIME_BOUND)} AS suppressed, {_HINT} AS mode FROM t")
def recency_mode(spark, d):
    q = F.col("question")
    return _asked(spark, d).select("conv_id", "turn", I.recency_suppressed(q).alias("suppressed"), I.recency_hint(q).alias("mode"))


_SAID = """WITH x(k, s) AS (VALUES (0, 'The evidence does not contain this. '), (1, 'Not specified, but it may be '), (2, 'It is '), (3, 'There is no mention of it. ')),
t AS (SELECT conv_id, turn, s || text AS answer, CASE WHEN turn % 3 = 0 THEN [1] ELSE [] END AS cites FROM conversations JOIN x ON (conv_id + turn) % 4 = k)"""


@query(f"{_SAID} SELECT conv_id, turn, CASE WHEN NOT {_m(I.ABSTENTION, 'answer')} THEN 'answered' WHEN len(cites) > 0 OR {_m(I.ASSERTION, 'answer')} THEN 'partial' ELSE 'abstained' END AS verdict FROM t")
def abstention_class(spark, d):
    c = table(spark, d, "conversations")
    pre = F.element_at(F.array(*[F.lit(s) for s in ("The evidence does not contain this. ", "Not specified, but it may be ", "It is ", "There is no mention of it. ")]), ((F.col("conv_id") + F.col("turn")) % 4 + 1).cast("int"))
    cites = F.when(F.col("turn") % 3 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return c.select("conv_id", "turn", I.abstention(F.concat(pre, "text"), cites).alias("verdict"))


@query("""WITH t AS (SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN ' YES. ' WHEN 1 THEN 'insufficient   information' WHEN 2 THEN '"Inconsistent"' WHEN 3 THEN 'Sam  B' ELSE text END AS gold FROM conversations),
n AS (SELECT conv_id, turn, regexp_replace(regexp_replace(lower(trim(gold)), '[ \\t\\n\\r\\f]+', ' ', 'g'), '^[.,;:!?"''() ]+|[.,;:!?"''() ]+$', '', 'g') AS n FROM t)
SELECT conv_id, turn, CASE WHEN n IN ('insufficient information', 'insufficient info') THEN 'null' WHEN n IN ('yes', 'no', 'true', 'false', 'consistent', 'inconsistent', 'agree', 'disagree') THEN 'boolean' ELSE 'entity' END AS answer_class FROM n""")
def answer_class(spark, d):
    from palimpsest.functions.text import answer_class as classify

    k = (F.col("conv_id") + F.col("turn")) % 5
    gold = F.when(k == 0, " YES. ").when(k == 1, "insufficient   information").when(k == 2, '"Inconsistent"').when(k == 3, "Sam  B").otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", classify(gold).alias("answer_class"))
