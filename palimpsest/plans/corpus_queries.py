"""Queries over documents, pages, events and conversations: parsing, screening, links, tenancy, lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from palimpsest.functions import text as T
from palimpsest.operators import access, lifecycle, links, locators, parsing, screening
from palimpsest.plans.registry import query
from palimpsest.sources.tables import facts, kb_pages, table

PAGES = """kb AS (SELECT doc_id AS page_id, 'doc-' || doc_id AS slug, string_split(text, chr(10))[1] AS title, source AS workspace, doc_id % 7 AS owner,
  CASE WHEN doc_id % 5 = 0 THEN ['self:u' || (doc_id % 7)] ELSE ['ws:' || source] END AS acl, CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS DATE) AS effective_date, doc_id % 11 = 0 AS deleted, text AS body FROM documents)"""
GRANTS = ("self:u3", "ws:src1", "ws:src2")
_LIST = "['self:u3', 'ws:src1', 'ws:src2']"


# --- parsing and screening -------------------------------------------------

@query("""WITH t AS (SELECT doc_id, text, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x FROM documents),
m AS (SELECT doc_id, length(x) AS n, length(regexp_replace(x, '[^\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}\\x{FFFD}]', '', 'g')) AS bad, list_max(list_transform(regexp_split_to_array(x, '[ \\t\\n\\r\\f]+'), lambda w: length(w))) AS run FROM t)
SELECT doc_id, CASE WHEN n = 0 THEN 'empty' WHEN n < 40 THEN 'too_short' WHEN 10 * bad > n THEN 'binary' WHEN run > 2000 THEN 'no_word_boundaries' ELSE 'ok' END AS verdict FROM m""")
def junk_gate(spark, d):
    return screening.junk_gate(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "verdict")


@query("SELECT doc_id, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS INTEGER) AS words FROM documents")
def word_count(spark, d):
    return table(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"))


_STRIP = r"""regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g')"""
_DECODE = "replace(replace(replace(replace(replace(replace({0}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
_FLAT = "trim(regexp_replace({0}, '[ \\t\\n\\r\\f]+', ' ', 'g'))"


@query(f"SELECT page_id, {_FLAT.format(_DECODE.format(f'''regexp_replace({_STRIP}, '<[^>]*>', ' ', 'g')'''))} AS text FROM pages")
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", parsing.html_text(F.col("html")).alias("text"))


@query(f"SELECT page_id, {_FLAT.format(_DECODE.format('''regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)'''))} AS title FROM pages")
def html_title(spark, d):
    return table(spark, d, "pages").select("page_id", parsing.html_title(F.col("html")).alias("title"))


@query("SELECT page_id, CAST(pos AS INTEGER) AS pos, href FROM (SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a[^>]*href=\"([^\"]*)\"', 1) AS h FROM pages))")
def html_links(spark, d):
    h = F.regexp_extract_all("html", F.lit("(?i)<a[^>]*href=\"([^\"]*)\""), 1)
    return table(spark, d, "pages").select("page_id", F.posexplode(h).alias("pos", "href"))


@query(r"""WITH b AS (SELECT page_id, unnest(x) AS raw, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT page_id, list_concat(regexp_extract_all(""" + _STRIP + r""", '(?is)<li[^>]*>.*?</li>'), regexp_extract_all(""" + _STRIP + r""", '(?is)<p[^>]*>.*?</p>')) AS x FROM pages))
SELECT page_id, sum(CASE WHEN starts_with(lower(raw), '<li') THEN 1 ELSE 0 END)::BIGINT AS items, sum(CASE WHEN starts_with(lower(raw), '<p') THEN 1 ELSE 0 END)::BIGINT AS paragraphs FROM b GROUP BY page_id""")
def html_block_counts(spark, d):
    b = parsing.html_blocks(table(spark, d, "pages"))
    n = b.groupBy("page_id").agg(F.sum(F.when(F.col("tag") == "li", 1).otherwise(0)).alias("items"), F.sum(F.when(F.col("tag") == "p", 1).otherwise(0)).alias("paragraphs"))
    return n.where("items + paragraphs > 0")


@query()
def html_blocks(spark, d):
    return parsing.html_blocks(table(spark, d, "pages"))


@query()
def text_blocks(spark, d):
    return parsing.markdown_blocks(table(spark, d, "documents"))


@query()
def chunk_text(spark, d):
    from palimpsest.operators.chunking import chunk_documents

    return chunk_documents(table(spark, d, "documents"))


@query()
def chunk_blocks(spark, d):
    from palimpsest.operators.chunking import chunk_page_blocks

    blocks = parsing.html_blocks(table(spark, d, "pages"))
    return chunk_page_blocks(blocks.select(F.col("page_id").alias("doc_id"), "pos", "kind", "level", "text", F.lit(None).cast("string").alias("header")))


@query()
def chunk_located(spark, d):
    """Chunks of all documents' blocks, each with the written place of its text."""
    from palimpsest.operators.chunking import chunk_page_blocks

    c = chunk_page_blocks(parsing.markdown_blocks(table(spark, d, "documents")))
    return c.select("doc_id", "ord", "content", locators.written(F.col("locator")).alias("place"))


_TIDY = r"regexp_replace(regexp_replace(regexp_replace(replace({0}, chr(173), ''), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')".format("text")


def _file_pages(spark, d):
    """Documents as the pages of files, four a file."""
    return table(spark, d, "documents").select(F.expr("doc_id div 4").alias("doc_id"), (F.col("doc_id") % 4 + 1).alias("page"), "text")


@query(rf"""WITH t AS (SELECT doc_id // 4 AS doc_id, doc_id % 4 + 1 AS page, {_TIDY} AS t FROM documents),
p AS (SELECT doc_id, page, unnest(regexp_split_to_array(t, '\n{{2,}}')) AS p, generate_subscripts(regexp_split_to_array(t, '\n{{2,}}'), 1) - 1 AS i FROM t WHERE length(t) >= 40)
SELECT doc_id, page * 4294967296 + i AS pos, trim(replace(p, chr(10), ' ')) AS text, 'p.' || page AS place FROM p WHERE trim(replace(p, chr(10), ' ')) <> ''""")
def page_blocks(spark, d):
    b = locators.page_blocks(_file_pages(spark, d))
    return b.select("doc_id", "pos", "text", locators.written(F.col("locator")).alias("place"))


@query(f"SELECT doc_id // 4 AS doc_id, count(*) FILTER (WHERE coalesce(length({_TIDY}), 0) >= 40) AS extracted, count(*) FILTER (WHERE coalesce(length({_TIDY}), 0) < 40) AS skipped FROM documents GROUP BY ALL")
def page_units(spark, d):
    return locators.page_units(_file_pages(spark, d))


@query("SELECT event_id, '/' || k AS pointer, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_pointers(spark, d):
    """Every key of each object as a pointer, with its value."""
    e = table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("k", "value"))
    return e.select("event_id", F.concat(F.lit("/"), "k").alias("pointer"), "value")


# --- identity of content ----------------------------------------------------

@query("SELECT doc_id, sha256(text) AS sha, doc_id = min(doc_id) OVER (PARTITION BY text) AS first, count(*) OVER (PARTITION BY text) AS copies FROM documents")
def content_dup(spark, d):
    return screening.content_duplicates(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id", "sha", "first", "copies")


_SLUG = "regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace({0}, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^www\\.', '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_SLUGIFY = "CASE WHEN s = '' THEN left(sha256(x), 12) WHEN length(s) > 200 THEN left(s, 187) || '-' || left(sha256(x), 12) ELSE s END"


@query(f"WITH a AS (SELECT doc_id, text AS x FROM documents), t AS (SELECT doc_id, x, {_SLUG.format('x')} AS s FROM a) SELECT doc_id, {_SLUGIFY} AS slug FROM t")
def slugify(spark, d):
    return table(spark, d, "documents").select("doc_id", T.slugify(F.col("text")).alias("slug"))


@query(f"""WITH a AS (SELECT doc_id, string_split(text, chr(10))[1] AS x FROM documents), t AS (SELECT doc_id, x, {_SLUG.format('x')} AS s FROM a), u AS (SELECT doc_id, {_SLUGIFY} AS slug FROM t)
SELECT slug, count(*) AS members, min(doc_id) AS first_id, max(doc_id) AS last_id FROM u GROUP BY slug HAVING count(*) > 1""")
def slug_collisions(spark, d):
    s = table(spark, d, "documents").select("doc_id", T.slugify(F.substring_index("text", "\n", 1)).alias("slug"))
    return s.groupBy("slug").agg(F.count("*").alias("members"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("members > 1")


@query("""WITH base AS (SELECT vec_id AS fact_id, label AS entity, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
f AS (SELECT * FROM base UNION ALL SELECT fact_id + 1000000, entity, vec FROM base WHERE fact_id % 25 = 0
      UNION ALL SELECT fact_id + 1000000, entity, list_concat([vec[1] + 0.05::DOUBLE], vec[2:]) FROM base WHERE fact_id % 25 = 1),
p AS (SELECT a.fact_id, b.fact_id AS into_id, list_cosine_similarity(a.vec, b.vec) AS cos FROM f a JOIN f b ON a.entity = b.entity AND b.fact_id < a.fact_id),
r AS (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY round(cos, 12) DESC, into_id) AS k FROM p)
SELECT fact_id, into_id, round(cos, 6) AS cos FROM r WHERE k = 1 AND cos >= 0.95""")
def near_dup_consolidate(spark, d):
    from palimpsest.operators.facts import consolidate

    return consolidate(facts(spark, d), 0.95)


@query("""WITH b AS (SELECT source, left(sha256(text), 3) AS bin, sha256(string_agg(sha256(text), chr(10) ORDER BY sha256(text))) AS h, count(*) AS n FROM documents GROUP BY ALL)
SELECT source, sha256(string_agg(bin || ':' || h, chr(10) ORDER BY bin)) AS fingerprint, sum(n)::BIGINT AS n FROM b GROUP BY source""")
def dataset_fingerprint(spark, d):
    return screening.fingerprints(table(spark, d, "documents"), "source", "text")


# --- links -------------------------------------------------------------------

_MENTIONS = r"""nm AS (SELECT page_id, lower(trim(CASE WHEN trim(title) = '' THEN slug ELSE title END)) AS name FROM (SELECT page_id, slug, regexp_replace(title, '^[^A-Za-z0-9_]+|[^A-Za-z0-9_]+$', '', 'g') AS title FROM kb)),
bodies AS (SELECT page_id, lower(regexp_replace({body}, '\[[^\]]+\]\([^)\s]+\)', ' ', 'g')) AS b FROM kb),
near AS MATERIALIZED (SELECT page_id, name FROM bodies JOIN (SELECT DISTINCT name FROM nm WHERE length(name) >= 6) ON contains(b, name)),
hit AS (SELECT page_id AS from_page_id, name FROM near JOIN bodies USING (page_id) WHERE regexp_matches(b, '\b' || regexp_escape(name) || '\b')),
mentioned AS (SELECT from_page_id, page_id AS to_page_id, name FROM hit JOIN nm USING (name) WHERE page_id <> from_page_id)"""


@query(f"WITH {PAGES}, {_MENTIONS.format(body='body')} SELECT * FROM mentioned QUALIFY row_number() OVER (PARTITION BY from_page_id ORDER BY length(name) DESC, to_page_id) <= 50")
def mention_links(spark, d):
    """Mentions of all pages' whole titles, or their slugs where they have none: every page of a name, fifty links out of a page at most."""
    return links.mentions(kb_pages(spark, d).select("page_id", "body"), _page_names(spark, d))


def _page_names(spark, d):
    """Titles without the punctuation at their ends, after which no word could begin."""
    return links.names(kb_pages(spark, d).select("page_id", "slug", F.regexp_replace("title", "^[^A-Za-z0-9_]+|[^A-Za-z0-9_]+$", "").alias("title")))


_MD = """md AS (SELECT doc_id AS page_id, 'see [a](/page/doc-' || (doc_id + 1) || '#top) and [b](doc-' || (doc_id * 2) || '?x=1) or [c](http://x.y)' AS body FROM documents),
h AS (SELECT page_id, unnest(regexp_extract_all(body, '\\[[^\\]]+\\]\\(([^)\\s]+)\\)', 1)) AS raw FROM md),
n AS (SELECT DISTINCT page_id, regexp_extract(regexp_replace(raw, '^/?(page/)?', ''), '^[^#?]*') AS href FROM h)"""


@query(f"WITH {_MD} SELECT page_id AS from_page_id, doc_id AS to_page_id, href FROM n JOIN documents ON 'doc-' || doc_id = href")
def md_links(spark, d):
    return links.markdown_links(_md_bodies(spark, d), kb_pages(spark, d).select("page_id", "slug"))


def _md_bodies(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    body = F.concat(F.lit("see [a](/page/doc-"), i + 1, F.lit("#top) and [b](doc-"), i * 2, F.lit("?x=1) or [c](http://x.y)"))
    return table(spark, d, "documents").select(i.alias("page_id"), body.alias("body"))


@query(f"WITH {_MD}, l AS (SELECT page_id AS from_page_id, doc_id AS to_page_id FROM n JOIN documents ON 'doc-' || doc_id = href) SELECT to_page_id AS page_id, count(*) AS backlinks, min(from_page_id) AS first_from FROM l GROUP BY to_page_id")
def backlinks(spark, d):
    found = md_links(spark, d)
    return found.groupBy(F.col("to_page_id").alias("page_id")).agg(F.count("*").alias("backlinks"), F.min("from_page_id").alias("first_from"))


_LINKED = "body || ' see [a](/page/doc-' || (page_id + 1) || '#top) and [b](doc-' || (page_id * 2) || '?x=1) or [c](http://x.y)'"


@query(f"""WITH {PAGES}, {_MENTIONS.format(body=_LINKED)},
h AS (SELECT page_id, unnest(regexp_extract_all({_LINKED}, '\\[[^\\]]+\\]\\(([^)\\s]+)\\)', 1)) AS raw FROM kb),
n AS (SELECT DISTINCT page_id, regexp_extract(regexp_replace(raw, '^/?(page/)?', ''), '^[^#?]*') AS href FROM h),
pairs AS (SELECT n.page_id AS from_page_id, kb.page_id AS to_page_id, 'markdown' AS link_kind, href AS link_source FROM n JOIN kb ON slug = href UNION ALL SELECT from_page_id, to_page_id, 'mention', name FROM mentioned)
SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY from_page_id ORDER BY length(link_source) DESC, to_page_id, link_kind, link_source) <= 50""")
def link_cap(spark, d):
    """At most fifty links out of each page, of both kinds together, those of the longest sources first."""
    p, k = kb_pages(spark, d), F.col("page_id")
    more = F.concat(F.col("body"), F.lit(" see [a](/page/doc-"), k + 1, F.lit("#top) and [b](doc-"), k * 2, F.lit("?x=1) or [c](http://x.y)"))
    bodies = p.select("page_id", more.alias("body"))
    named = _page_names(spark, d)
    return links.capped(links.markdown_links(bodies, p.select("page_id", "slug")), links.mentioned(bodies, named), named=named)


# --- tenancy ------------------------------------------------------------------

@query(f"WITH {PAGES} SELECT page_id, workspace FROM kb WHERE workspace IN ('src1', 'src2') AND list_has_any(acl, {_LIST}) AND NOT deleted")
def acl_visible(spark, d):
    p = kb_pages(spark, d).where(F.col("workspace").isin("src1", "src2"))
    return access.visible(p, GRANTS).select("page_id", "workspace")


@query(f"""WITH {PAGES}, e AS (SELECT page_id AS f, (page_id * 7 + 3) % (SELECT count(*) FROM kb) AS t FROM kb)
SELECT f AS from_page_id, t AS to_page_id FROM e JOIN kb a ON a.page_id = f JOIN kb b ON b.page_id = t WHERE list_has_any(a.acl, ['self:u3', 'ws:src1', 'ws:src2', 'ws:src3', 'ws:src4', 'ws:src5']) AND list_has_any(b.acl, ['self:u3', 'ws:src1', 'ws:src2', 'ws:src3', 'ws:src4', 'ws:src5']) AND NOT a.deleted AND NOT b.deleted""")
def edge_visible(spark, d):
    return access.visible_edges(_one_edge(spark, d), kb_pages(spark, d), (*GRANTS, "ws:src3", "ws:src4", "ws:src5"))


def _one_edge(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "documents").select("doc_id")
    n = F.broadcast(p.agg(F.count("*").alias("n")))  # one row
    return p.crossJoin(n).select(F.col("doc_id").alias("from_page_id"), ((F.col("doc_id") * 7 + 3) % F.col("n")).alias("to_page_id"))


@query("WITH g AS (SELECT c_custkey AS user_id, 'team:' || c_mktsegment AS tag FROM customer UNION ALL SELECT o_custkey, 'role:' || o_orderpriority FROM orders WHERE o_orderstatus = 'F') SELECT c_custkey AS user_id, len(list_distinct(list_concat(['self:u' || c_custkey, 'ws:n' || c_nationkey], coalesce((SELECT list(tag) FROM g WHERE user_id = c_custkey), []))))::INTEGER AS tags FROM customer")
def keyring(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    extra = c.select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("team:"), "c_mktsegment").alias("tag")).unionByName(o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("user_id"), F.concat(F.lit("role:"), "o_orderpriority").alias("tag")))
    users = c.select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("n"), "c_nationkey").alias("workspace"))
    return access.keyring(users, extra).select("user_id", F.size("keyring").alias("tags"))


@query("""WITH a AS (SELECT doc_id, list_concat(CASE WHEN doc_id % 5 = 0 THEN ['self:u' || (doc_id % 7)] ELSE ['ws:' || source] END, CASE doc_id % 9 WHEN 1 THEN ['team:x'] WHEN 2 THEN ['bad tag'] WHEN 3 THEN ['role:admin'] ELSE [] END) AS acl, source FROM documents),
t AS (SELECT source, unnest(acl) AS tag FROM a)
SELECT source, count(*) AS total, count(*) FILTER (WHERE NOT regexp_matches(tag, '^(self|ws|team|role):[A-Za-z0-9_-]+$')) AS malformed, count(*) FILTER (WHERE regexp_matches(tag, '^(team|role):')) AS unmintable FROM t GROUP BY source""")
def acl_census(spark, d):
    extra = F.when(F.col("doc_id") % 9 == 1, F.array(F.lit("team:x"))).when(F.col("doc_id") % 9 == 2, F.array(F.lit("bad tag"))).when(F.col("doc_id") % 9 == 3, F.array(F.lit("role:admin"))).otherwise(F.array().cast("array<string>"))
    acl = F.when(F.col("doc_id") % 5 == 0, F.array(F.concat(F.lit("self:u"), F.col("doc_id") % 7))).otherwise(F.array(F.concat(F.lit("ws:"), "source")))
    return access.census(table(spark, d, "documents").select("source", F.concat(acl, extra).alias("acl")), "source")


@query("""WITH c AS (SELECT doc_id, source, CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN ['ws:old'] ELSE ['ws:' || source] END AS acl FROM documents)
SELECT source, count(*) AS chunks, count(*) FILTER (WHERE acl IS DISTINCT FROM ['ws:' || source]) AS drifted FROM c GROUP BY source""")
def chunk_drift(spark, d):
    docs = table(spark, d, "documents")
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("source").alias("workspace"), F.array(F.concat(F.lit("ws:"), "source")).alias("acl"))
    chunk = docs.select(F.col("doc_id").alias("page_id"), F.when(F.col("doc_id") % 17 == 0, F.lit(None)).when(F.col("doc_id") % 13 == 0, F.array(F.lit("ws:old"))).otherwise(F.array(F.concat(F.lit("ws:"), "source"))).alias("acl"))
    return access.drift(chunk, pages).groupBy(F.col("workspace").alias("source")).agg(F.count("*").alias("chunks"), F.count_if("drifted").alias("drifted"))


# --- lifecycle ------------------------------------------------------------------

@query(f"WITH {PAGES} SELECT page_id, slug, CAST(effective_date AS VARCHAR) AS effective_date, n > 70 AS has_more FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY effective_date DESC, page_id) AS k FROM kb WHERE NOT deleted) WHERE k > 20 AND k <= 70")
def page_listing(spark, d):
    return lifecycle.page_listing(kb_pages(spark, d).where("NOT deleted").select("page_id", "slug", "effective_date"), 50, 20).withColumn("effective_date", F.col("effective_date").cast("string"))


@query("SELECT p_partkey AS page_id, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AS has_source FROM part")
def has_source(spark, d):
    src = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("page_id"))
    return lifecycle.has_source(table(spark, d, "part").select(F.col("p_partkey").alias("page_id")), src)


@query("SELECT o_orderkey AS page_id, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25) AS chunk_count FROM orders")
def chunk_count(spark, d):
    c = table(spark, d, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("page_id"))
    return lifecycle.chunk_counts(table(spark, d, "orders").select(F.col("o_orderkey").alias("page_id")), c)


_IDS = "ids AS (SELECT doc_id * 3 AS id FROM documents)"


@query(f"WITH {PAGES}, {_IDS} SELECT id, CASE WHEN page_id IS NULL OR deleted OR NOT list_has_any(acl, ['self:u3', 'ws:src1', 'ws:src2', 'ws:src0']) THEN 'not_visible' WHEN owner <> 3 THEN 'not_author' ELSE 'ok' END AS outcome FROM ids LEFT JOIN kb ON page_id = id")
def soft_delete_outcomes(spark, d):
    ids = table(spark, d, "documents").select((F.col("doc_id") * 3).alias("id"))
    return lifecycle.delete_outcomes(kb_pages(spark, d), ids, (*GRANTS, "ws:src0"), 3)


@query(f"WITH {PAGES}, {_IDS} SELECT id, CASE WHEN page_id IS NULL OR deleted OR NOT list_has_any(acl, ['self:u3', 'ws:src1', 'ws:src2', 'ws:src0']) THEN 'not_visible' WHEN owner <> 3 THEN 'not_author' WHEN acl = ['self:u3'] THEN 'unchanged' WHEN slug IN (SELECT slug FROM kb WHERE page_id % 28 = 0) THEN 'collision' ELSE 'ok' END AS outcome FROM ids LEFT JOIN kb ON page_id = id")
def rescope_outcomes(spark, d):
    p = kb_pages(spark, d)
    ids = table(spark, d, "documents").select((F.col("doc_id") * 3).alias("id"))
    return lifecycle.rescope_outcomes(p, ids, (*GRANTS, "ws:src0"), 3, F.array(F.lit("self:u3")), p.where("page_id % 28 = 0").select("slug"))


@query(f"WITH {PAGES} SELECT workspace, count(*) AS due FROM kb WHERE deleted AND effective_date < DATE '2024-06-30' - 30 GROUP BY workspace")
def purge_count(spark, d):
    return lifecycle.purge_counts(kb_pages(spark, d), "2024-06-30", 30)


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN sha256(text) ELSE 'stale' END IS DISTINCT FROM sha256(text) AND doc_id > 100 ORDER BY doc_id LIMIT 50")
def changed_since_stamp(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    stamp = F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 1, F.col("content_hash")).otherwise("stale")
    return lifecycle.changed_since(t.withColumn("stamp", stamp), 100, 50).select("doc_id", "content_hash")


@query("WITH v(id, sum) AS (SELECT n_nationkey, md5(n_name) FROM nation WHERE n_nationkey < 20), l(id, sum) AS (SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'x' ELSE md5(n_name) END FROM nation WHERE n_nationkey >= 5) SELECT coalesce(v.id, l.id) AS id, CASE WHEN l.id IS NULL THEN 'pending' WHEN v.id IS NULL THEN 'orphan' WHEN v.sum <> l.sum THEN 'drifted' ELSE 'applied' END AS state FROM v FULL JOIN l ON v.id = l.id")
def migration_ledger(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.md5("n_name").alias("sum"))
    ledger = n.where("id >= 5").withColumn("sum", F.when(F.col("id") % 4 == 0, "x").otherwise(F.col("sum")))
    return lifecycle.migration_ledger(n.where("id < 20"), ledger)


@query("SELECT conv_id, count(*) AS turns, sha256(string_agg(role || ': ' || trim(text), chr(10) ORDER BY turn)) AS digest FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def session_render(spark, d):
    from palimpsest.operators.sessions import render

    return render(table(spark, d, "conversations")).select("conv_id", "turns", F.sha2("rendered", 256).alias("digest"))


@query("""WITH t AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ' First.Last+' || c_custkey || '@GoogleMail.com ' WHEN 1 THEN 'A.B' || c_custkey || '@Corp.example' WHEN 2 THEN 'no address' ELSE 'x.' || c_custkey || '+t@gmail.com' END AS raw FROM customer),
s AS (SELECT c_custkey, regexp_extract(lower(trim(raw)), '^(.+)@([^@]*)$', 1) AS l, regexp_extract(lower(trim(raw)), '^(.+)@([^@]*)$', 2) AS dm FROM t)
SELECT c_custkey, CASE WHEN l = '' OR dm = '' THEN NULL WHEN dm IN ('gmail.com', 'googlemail.com') THEN replace(string_split(l, '+')[1], '.', '') || '@gmail.com' ELSE l || '@' || dm END AS email FROM s""")
def email_norm(spark, d):
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit(" First.Last+"), k, F.lit("@GoogleMail.com "))).when(k % 4 == 1, F.concat(F.lit("A.B"), k, F.lit("@Corp.example"))).when(k % 4 == 2, "no address").otherwise(F.concat(F.lit("x."), k, F.lit("+t@gmail.com")))
    return table(spark, d, "customer").select("c_custkey", T.normalize_email(raw).alias("email"))


@query("""WITH i AS (SELECT o_orderkey AS invite_id, o_custkey AS workspace, o_orderdate AS created_at, o_orderstatus = 'F' AS claimed FROM orders)
SELECT invite_id, workspace FROM i WHERE NOT claimed AND created_at + INTERVAL 1000 DAY > TIMESTAMP '1998-06-01' AND workspace NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def invite_claim(spark, d):
    i = table(spark, d, "orders").select(F.col("o_orderkey").alias("invite_id"), F.col("o_custkey").alias("workspace"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderstatus") == "F").alias("claimed"))
    blocked = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("workspace"))
    return lifecycle.claimable(i, blocked, "1998-06-01", 1000).select("invite_id", "workspace")


@query("""WITH s AS (SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS actual, 2.5::DOUBLE AS estimated FROM events)
SELECT user_id, round(sum(coalesce(actual, estimated)), 4) AS spent, count(*) AS calls FROM s GROUP BY user_id""")
def budget_ledger(spark, d):
    s = table(spark, d, "events").select("user_id", F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.col("value")).alias("actual"), F.lit(2.5).alias("estimated"))
    return s.groupBy("user_id").agg(F.round(F.sum(F.coalesce("actual", "estimated")), 4).alias("spent"), F.count("*").alias("calls"))


@query("""WITH RECURSIVE c AS (SELECT user_id AS account, event_id AS seq, abs(value) AS cost, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f(account, seq, k, allowed, spent) AS (SELECT account, seq, k, cost <= 200, CASE WHEN cost <= 200 THEN cost ELSE 0 END FROM c WHERE k = 1
  UNION ALL SELECT c.account, c.seq, c.k, spent + cost <= 200, CASE WHEN spent + cost <= 200 THEN spent + cost ELSE spent END FROM f JOIN c ON c.account = f.account AND c.k = f.k + 1)
SELECT account, seq, allowed, round(spent, 6) AS spent FROM f""")
def budget_decisions(spark, d):
    from palimpsest.operators.folds import budget_decisions as decide

    e = table(spark, d, "events").select(F.col("user_id").alias("account"), F.col("event_id").alias("seq"), F.abs("value").alias("cost"))
    return decide(e, 200.0).withColumn("spent", F.round("spent", 6))


@query("""WITH RECURSIVE h AS (SELECT user_id AS key, event_id AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS sec, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS k FROM events),
f(key, seq, k, window_start, n) AS (SELECT key, seq, k, sec, 1::BIGINT FROM h WHERE k = 1
  UNION ALL SELECT h.key, h.seq, h.k, CASE WHEN sec >= window_start + 3600 THEN sec ELSE window_start END, CASE WHEN sec >= window_start + 3600 THEN 1 ELSE n + 1 END FROM f JOIN h ON h.key = f.key AND h.k = f.k + 1)
SELECT key, seq, window_start, n <= 2 AS allowed FROM f""")
def rate_windows(spark, d):
    from palimpsest.operators.folds import rate_windows as limit

    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.unix_timestamp("ts").alias("at"))
    return limit(e, 3600, 2)


@query("SELECT count(*) AS nothing_done, min(doc_id) AS first_id FROM documents")
def noop_phase(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("nothing_done"), F.min("doc_id").alias("first_id"))


@query("WITH e AS (SELECT user_id, event_id, event_type FROM events), c AS (SELECT user_id, max(event_id) FILTER (WHERE event_type = 'purchase') AS cleared FROM e GROUP BY user_id) SELECT e.user_id, count(*) AS attempts FROM e JOIN c USING (user_id) WHERE e.event_type = 'error' AND (cleared IS NULL OR event_id > cleared) GROUP BY e.user_id")
def failure_attempts(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    cleared = F.max(F.when(F.col("event_type") == "purchase", F.col("event_id"))).over(W.partitionBy("user_id"))
    return e.withColumn("c", cleared).where("event_type = 'error' AND (c IS NULL OR event_id > c)").groupBy("user_id").agg(F.count("*").alias("attempts"))
