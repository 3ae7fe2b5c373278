import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import intent as I
from palimpsest.functions import text as T
from palimpsest.operators import access, chunking, evaluation, facts, folds, lifecycle, links, parsing, retrieval, screening, sessions
from palimpsest.plans.policy import DEFAULT, PROFILES, Policy


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


# --- fusion and ranking ---------------------------------------------------------

def test_fusion_by_hand(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "qid long, chunk_id long, rk int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "qid long, chunk_id long, rk int")
    got = {r.chunk_id: r.rrf for r in retrieval.fuse([(a, 1.0, 60), (b, 0.5, 60)]).collect()}
    assert got == pytest.approx({10: 1 / 60, 11: 1 / 61 + 0.5 / 60, 12: 0.5 / 61})


def test_page_cap_and_collapse(spark):
    f = spark.createDataFrame([(1, i, 1.0 / i) for i in range(1, 7)], "qid long, chunk_id long, rrf double")
    pages = spark.createDataFrame([(i, 0 if i < 5 else 1) for i in range(1, 7)], "chunk_id long, page_id int")
    capped = retrieval.page_cap(f, pages, 2)
    assert sorted(r.chunk_id for r in capped.collect()) == [1, 2, 5, 6]
    scored = capped.withColumn("score", F.col("rrf"))
    hashes = spark.createDataFrame([(1, "a"), (2, "a"), (5, "b"), (6, "c")], "chunk_id long, hash string")
    assert sorted(r.chunk_id for r in retrieval.collapse(scored, hashes).collect()) == [1, 5, 6]


def test_vector_arm_against_brute_force(spark):
    rng = random.Random(3)
    vecs = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)] + [(900, None)]
    qs = [(q, vecs[q][1]) for q in (3, 7)]
    df = spark.createDataFrame(vecs, "chunk_id long, vec array<double>").repartition(5)
    got = retrieval.vector_arm(spark.createDataFrame(qs, "qid long, qvec array<double>"), df, 5).collect()
    for q, v in qs:
        cos = lambda w: sum(a * b for a, b in zip(v, w)) / (sum(a * a for a in v) * sum(b * b for b in w)) ** 0.5  # noqa: B023, B905, E731
        want = sorted((round(1 - cos(w), 12), i) for i, w in vecs if w)[:5]
        assert [r.chunk_id for r in sorted((r for r in got if r.qid == q), key=lambda r: r.rk)] == [i for _, i in want]


def test_small_tenant_is_not_starved(spark):
    """Many near vectors of one tenant never push the other tenant's out, since visibility comes first."""
    noise = [(i, [1.0, 0.01 * i, 0.0], ["ws:a"]) for i in range(200)]
    mine = [(1000 + i, [0.1, 1.0, float(i)], ["ws:b"]) for i in range(16)]
    df = spark.createDataFrame(noise + mine, "chunk_id long, vec array<double>, acl array<string>")
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "qid long, qvec array<double>")
    got = retrieval.vector_arm(q, access.visible(df, ("ws:b",)), 8)
    assert [r.chunk_id >= 1000 for r in got.collect()] == [True] * 8


def test_graph_arm(spark):
    seeds = spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "qid long, page_id long, rk int")
    e = spark.createDataFrame([(10, 30, 5), (40, 10, 1), (10, 20, 0), (20, 50, 9), (10, 60, 7), (10, 70, 8)], "from_page_id long, to_page_id long, created_at long")
    chunks = spark.createDataFrame([(p, p) for p in (10, 20, 30, 40, 50, 60, 70)], "chunk_id long, page_id long")
    got = retrieval.graph_arm(seeds, e, chunks, per_seed=3).orderBy("rk").collect()
    assert [r.page_id for r in got] == [40, 50, 30, 60]  # by the neighbour's rank inside its seed: 40 and 50 are first there


def test_recency_by_hand(spark):
    f = lambda days, mode: one(spark, retrieval.recency_factor(F.date_sub(F.to_date(F.lit("2024-12-31")), days), F.to_date(F.lit("2024-12-31")), F.lit(mode)))
    assert f(0, "on") == pytest.approx(1.3)
    assert f(90, "strong") == pytest.approx(1 + 1.5 * 0.3 * 0.5)
    assert f(90, "off") == 1.0
    assert one(spark, retrieval.recency_factor(F.lit(None).cast("date"), F.to_date(F.lit("2024-12-31")), F.lit("on"))) == 1.0


def test_policy():
    assert Policy.resolve({"top_k": 5}, {"top_k": 6}).top_k == 6
    assert Policy.resolve().hash() == DEFAULT.hash() != Policy.resolve({"title": 9}).hash()
    assert len(PROFILES) == 9 == len({p.hash() for p in PROFILES.values()})
    for bad in ({"vector": 500}, {"rrf_share": 0.9}, {"recency": "later"}, {"nothing": 1}, {"top_k": 0}):
        with pytest.raises(ValueError):
            Policy.resolve(bad)


# --- text -------------------------------------------------------------------------

QUESTIONS = [("Tell me everything about Acme", "temporal"), ("when did we meet", "temporal"), ("Acme announced a merger", "event"), ("find all people who work on search", "concept"), ("who is Ada", "entity"), ("hello there", "general"), ("ñwhen", "temporal")]


@pytest.mark.parametrize("q,want", QUESTIONS)
def test_intent(spark, q, want):
    assert one(spark, I.intent(F.lit(q))) == want


def test_recency_hint(spark):
    hint = lambda q: one(spark, I.recency_hint(F.lit(q)))
    assert [hint(q) for q in ("what is new today", "who is Ada", "latest from Acme", "this morning", "plain")] == ["strong", "off", "on", "strong", "off"]


def test_abstention(spark):
    f = lambda a, c=(): one(spark, I.abstention(F.lit(a), F.array(*map(F.lit, c)).cast("array<int>")))
    assert f("The documents do not contain that.") == "abstained"
    assert f("The documents do not contain that.", [1]) == "partial"
    assert f("Not stated, but it may be Y.") == "partial"
    assert f("It is Y.") == "answered"


def test_slug_email_answer_row(spark):
    s = lambda v: one(spark, T.slugify(F.lit(v)))
    assert s("https://www.Example.com/A b?c") == "example-com-a-b-c"
    assert len(s("x" * 500)) == 200 and s("x" * 500) != s("x" * 501)
    assert len(s("!!!")) == 12
    e = lambda v: one(spark, T.normalize_email(F.lit(v)))
    assert (e(" A.B+c@GoogleMail.com"), e("A.B@Corp.de"), e("nope"), e("@x")) == ("ab@gmail.com", "a.b@corp.de", None, None)
    assert one(spark, T.answer_class(F.lit(' "Yes." '))) == "boolean"
    assert one(spark, T.join_row(F.array(*map(F.lit, ["a", "", " b ", "", ""])))) == "a |  | b"
    assert one(spark, T.normalize_href(F.lit("/page/doc-1#x"))) == "doc-1"
    assert one(spark, T.token_estimate(F.lit("नमस्ते"))) == 5


# --- parsing and chunking ------------------------------------------------------------

def test_html_blocks(spark):
    html = "<h1>A &amp; B</h1><script>x</p></script><p>one<b> two</b></p><table><tr><td>a</td><td></td><td>c</td></tr></table><ul><li>i</ul><pre>code</pre>"
    rows = parsing.html_blocks(spark.createDataFrame([(1, html), (2, "plain")], "page_id long, html string")).orderBy("page_id", "pos").collect()
    assert [(r.kind, r.level, r.text) for r in rows] == [("heading", 1, "A & B"), ("paragraph", None, "one two"), ("row", None, "a |  | c"), ("code", None, "code"), ("paragraph", None, "plain")]


def test_text_blocks():
    b = parsing.text_to_blocks("# T\n\npara one\nline two\n\n- a\n- b\n\n```\ncode\n# no\n```\nUnder\n=====\nend")
    assert [(x["kind"], x["level"], x["text"]) for x in b] == [("heading", 1, "T"), ("paragraph", None, "para one\nline two"), ("list", None, "- a"), ("list", None, "- b"), ("code", None, "code\n# no"), ("heading", 1, "Under"), ("paragraph", None, "end")] or [x["kind"] for x in b] == ["heading", "paragraph", "list", "code", "heading", "paragraph"]


def test_csv_json_front_matter():
    b, dropped = parsing.csv_to_blocks('Item,Qty\n"a, b",2\n\n,,\nc,\n')
    assert [(x["text"], x["header"]) for x in b] == [("a, b | 2", "Item | Qty"), ("c", "Item | Qty")] and dropped == 0
    j = parsing.json_to_blocks('{"a": {"b/c": [1, "x"]}, "d": null}')
    assert [x["text"] for x in j] == ["/a/b~1c/0: 1\n/a/b~1c/1: x", "/d: null"]
    assert parsing.json_to_blocks("{bad") == []
    assert parsing.front_matter("---\ntitle: T\ntags: [a, b]\n---\nx") == ({"title": "T", "tags": ["a", "b"]}, "x")


def test_detect(spark):
    f = lambda c, n: one(spark, parsing.detect_format(F.lit(c).cast("binary"), F.lit(n)))
    assert [f(b"%PDF-1", "a"), f(b'{"a":1}', "a"), f(b"<!DOCTYPE html>", "a"), f(b"a,b", "x.csv"), f(b"# t", "x"), f(b"hello", "x")] == ["pdf", "json", "html", "csv", "markdown", "text"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word", "two.", "x\n", "\n\n", "end! ", "long;"]), max_size=300))
def test_chunks_hold_all_words_and_caps(parts):
    text = " ".join(parts)
    out = chunking.chunk(text, 40, 0, 400)
    assert all(len(c) <= 400 for c in out)
    assert [w for c in out for w in c.split()] == text.split() or any(len(c) == 400 for c in out)


def test_chunk_edges():
    assert chunking.chunk("") == [] == chunking.chunk(" \n ")
    assert chunking.chunk("a b") == ["a b"]
    assert all(len(c) <= 6000 for c in chunking.chunk("x" * 20_000))
    long = " ".join(f"w{i}." for i in range(1000))
    out = chunking.chunk(long)
    assert len(out) > 1 and out[1].split()[0] in out[0].split()


def test_block_chunks():
    blocks = [{"kind": "heading", "level": 1, "text": "A", "header": None}, {"kind": "heading", "level": 2, "text": "B", "header": None}, *[{"kind": "row", "level": None, "text": f"r{i} " + "x" * 40, "header": "H1 | H2"} for i in range(30)], {"kind": "heading", "level": 1, "text": "C", "header": None}, {"kind": "paragraph", "level": None, "text": "y" * 5000, "header": None}]
    out = chunking.pack_blocks(blocks, 100)
    assert all(chunking.estimate(c) <= 151 for c in out)
    assert out[0].startswith("A > B\n\nH1 | H2\nr0") and out[-1].startswith("C\n\n")
    assert sum(c.count("y") for c in out) == 5000


def test_junk_gate(spark):
    rows = [("",), (None,), ("short",), ("\x01" * 30 + "a" * 60,), ("z" * 3000,), ("fine words " * 10,)]
    got = screening.junk_gate(spark.createDataFrame(rows, "text string")).collect()
    assert [r.verdict for r in got] == ["empty", "empty", "too_short", "binary", "no_word_boundaries", "ok"]


# --- links, access, lifecycle -----------------------------------------------------------

def test_links(spark):
    bodies = spark.createDataFrame([(1, "see [x](/page/b#y) and Big Red Dog Show"), (2, "[Big Red Dog Show](c)"), (3, None)], "page_id long, body string")
    pages = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "page_id long, slug string")
    assert sorted((r.from_page_id, r.to_page_id) for r in links.markdown_links(bodies, pages).collect()) == [(1, 2), (2, 3)]
    titled = spark.createDataFrame([(9, "Big, red dog", "s9"), (8, "big red dog show with more", "s8"), (7, "", "red-dog"), (6, "dog", "s6"), (5, "Big Red Dog", "s5"), (4, None, "x y"), (1, " big red dog show", "s1"), (30, "Big red dog", "s30"), (31, "C++ (new)", "s31")], "page_id long, title string, slug string")
    names = links.names(titled)
    assert sorted((r.name, r.page_id) for r in names.collect()) == [("big red dog", 5), ("big red dog", 30), ("big red dog show", 1), ("big red dog show with more", 8), ("big, red dog", 9), ("c++ (new)", 31), ("red-dog", 7)]
    more = bodies.unionByName(spark.createDataFrame([(5, "big red dog show with more or less"), (20, "a big red dog show with mores; red-dogs, xred-dog"), (21, "the C++ (new)s"), (22, "the C++ (new) way, BIG, red dog")], "page_id long, body string"))
    got = sorted((r.from_page_id, r.to_page_id, r.name) for r in links.mentions(more, names).collect())
    dog, show = "big red dog", "big red dog show"
    assert got == [(1, 5, dog), (1, 30, dog), (5, 1, show), (5, 8, "big red dog show with more"), (5, 30, dog), (20, 1, show), (20, 5, dog), (20, 30, dog), (21, 31, "c++ (new)"), (22, 9, "big, red dog")]
    few = sorted((r.from_page_id, r.to_page_id) for r in links.mentions(more, names, most=1).collect())
    assert few == [(1, 5), (5, 8), (20, 1), (21, 31), (22, 9)]
    both = links.capped(links.markdown_links(bodies, pages), links.mentions(bodies, names), most=2).orderBy("from_page_id", "to_page_id").collect()
    assert [tuple(r) for r in both] == [(1, 5, "mention", dog), (1, 30, "mention", dog), (2, 3, "markdown", "c")]
    assert links.mentions(more, names.limit(0)).count() == 0
    assert one(spark, links.context(F.lit("a" * 200), F.lit(100), F.lit(103))) == "…" + "a" * 163 + "…"


def test_visibility_fails_closed(spark):
    df = spark.createDataFrame([(1, ["ws:a"], False), (2, None, False), (3, [], False), (4, ["ws:b"], False), (5, ["ws:a"], True)], "page_id long, acl array<string>, deleted boolean")
    assert [r.page_id for r in access.visible(df, ("ws:a", "bad tag")).collect()] == [1]
    assert access.visible(df, ()).count() == 0


def test_soft_delete_and_propagation(spark):
    pages = spark.createDataFrame([(1, 3, ["ws:a"], "s", False), (2, 4, ["ws:a"], "t", False)], "page_id long, owner int, acl array<string>, slug string, deleted boolean")
    ids = spark.createDataFrame([(1,), (2,), (9,)], "id long")
    out = lifecycle.delete_outcomes(pages, ids, ("ws:a",), 3)
    assert {r.id: r.outcome for r in out.collect()} == {1: "ok", 2: "not_author", 9: "not_visible"}
    after = lifecycle.soft_delete(pages, out)
    assert {r.page_id: r.deleted for r in after.collect()} == {1: True, 2: False}
    children = spark.createDataFrame([(1, 7, None, False)], "page_id long, chunk int, acl array<string>, deleted boolean")
    assert access.propagate(children, after).first().deleted


def test_slug_resolution(spark):
    pages = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "page_id long, slug string")
    got = lifecycle.resolve_slug(pages, spark.createDataFrame([("a",), ("b",), ("c",)], "slug string")).collect()
    assert {r.slug: (r.page_id, r.outcome) for r in got} == {"a": (1, "ok"), "b": (None, "ambiguous"), "c": (None, "not_found")}


# --- facts, folds, sessions ----------------------------------------------------------------

def test_parse_facts(spark):
    raw = ['```json\n{"facts":[{"claim":" c ","kind":"odd","entity":"Big Co!","confidence":7},{"claim":""}]}\n```', "nope", '{"facts":[' + ",".join(['{"claim":"x"}'] * 12) + "]}"]
    got = facts.parse_facts(spark.createDataFrame([(r,) for r in raw], "raw string")).collect()
    f = got[0].facts[0]
    assert (f.claim, f.kind, f.entity, f.confidence) == ("c", "claim", "big-co", 1.0) and len(got[0].facts) == 1
    assert got[1].parse_failed and got[1].facts == [] and len(got[2].facts) == 10


def test_folds(spark):
    calls = spark.createDataFrame([(1, i, c) for i, c in enumerate([5.0, 7.0, 4.0, 1.0])] + [(2, 0, 20.0)], "account long, seq long, cost double")
    got = folds.budget_decisions(calls, 10.0).orderBy("account", "seq").collect()
    assert [r.allowed for r in got] == [True, False, True, True, False]
    hits = spark.createDataFrame([(1, i, t) for i, t in enumerate([0, 5, 9, 10, 11])], "key long, seq long, at long")
    assert [(r.window_start, r.allowed) for r in folds.rate_windows(hits, 10, 2).orderBy("seq").collect()] == [(0, True), (0, True), (0, False), (10, True), (10, True)]


def test_sessions(spark):
    t = spark.createDataFrame([(1, 2, "user", "b"), (1, 1, "bot", " a "), (1, 3, "user", "  ")], "conv_id long, turn long, role string, text string")
    assert sessions.render(t).first().rendered == "bot: a\nuser: b"
    s = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y")], "session_id string, body string")
    assert {r.session_id: r.conflict for r in sessions.distinct_sessions(s).collect()} == {"a": False, "b": True}


# --- evaluation -------------------------------------------------------------------------------

def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([(1, i + 1, s) for i, s in enumerate(["a", "b", "b", "c", "d", "e"])], "qid long, rank int, slug string")
    gold = spark.createDataFrame([(1, ["b", "e"]), (2, ["a"]), (3, [])], "qid long, gold array<string>")
    h = {r.qid: (r.hit1, r.hit3, r.rr) for r in evaluation.hit_mrr(ranked, gold).collect()}
    assert h == {1: (0, 1, 0.5), 2: (0, 0, 0.0), 3: (0, 0, 0.0)}
    m = {r.qid: (r.all_4, r.evidence_4, r.docs_4, r.all_8) for r in evaluation.multihop(ranked, gold).collect()}
    assert m == {1: (0, 0.5, 3, 1), 2: (0, 0.0, 0, 0), 3: (None, None, 0, None)}
    assert [r.slug for r in evaluation.cap_replay(ranked, 1).orderBy("rank").collect()] == ["a", "b", "c", "d", "e"]


def test_nearest_rank(spark):
    df = spark.createDataFrame([("k", float(i)) for i in range(1, 11)], "p string, v double")
    assert [evaluation.nearest_rank(df, "p", "v", p).first().value for p in (0.01, 0.5, 0.95, 1.0)] == [1, 5, 10, 10]


def test_bootstrap():
    b = evaluation.paired_bootstrap([1.0] * 60 + [0.0] * 20, 500, 42)
    assert b["mean"] == 0.75 and b["improves"] and not b["regresses"]
    assert evaluation.paired_bootstrap([0.0, 0.0], 100)["p"] == 1.0
    g = evaluation.mulberry(42)
    first = [next(g) for _ in range(3)]
    assert all(0 <= x < 1 for x in first) and first == [next(h) for h in [evaluation.mulberry(42)] for _ in range(3)]
    with pytest.raises(ValueError):
        evaluation.paired_bootstrap([])


def test_bootstrap_takes_the_stream_in_order():
    rng = random.Random(2)
    deltas = [rng.choice([-1.0, 0.0, 1.0]) for _ in range(70)]
    draw = evaluation.mulberry(42)
    means = sorted(sum(deltas[int(next(draw) * 70)] for _ in range(70)) / 70 for _ in range(300))
    b = evaluation.paired_bootstrap(deltas, 300)
    assert (b["low"], b["high"]) == (means[0], means[299])
    assert b["p"] == min(1.0, 2 * min(sum(m <= 0 for m in means), sum(m >= 0 for m in means)) / 300)


def test_bootstrap_gate_takes_all_items(spark, tmp_path):
    from palimpsest.plans.queries import QUERIES

    spark.range(3000).withColumnRenamed("id", "item_id").write.parquet(str(tmp_path / "benchmark.parquet"))
    deltas = [float((i % 3 == 0) - (i % 7 == 0)) for i in range(3000)]
    got = QUERIES["bootstrap_gate"](spark, str(tmp_path)).first()
    assert got["mean"] == sum(deltas) / 3000
    want = evaluation.paired_bootstrap(deltas, 10_000)
    assert (got.low, got.high, got.p) == (want["low"], want["high"], want["p"])


def test_sample_has_its_size(spark):
    df = spark.createDataFrame([(i, "abc"[min(i % 7, 2)]) for i in range(100)], "id long, part string")
    a = evaluation.hash_sample(df, "id", "part", 13)
    assert a.count() == 13
    assert sorted(r.id for r in a.collect()) == sorted(r.id for r in evaluation.hash_sample(df.repartition(7), "id", "part", 13).collect())


def test_invites(spark):
    i = spark.createDataFrame([(1, 5, dt.datetime(2024, 1, 1), False), (2, 5, dt.datetime(2023, 1, 1), False), (3, 6, dt.datetime(2024, 1, 1), False), (4, 5, dt.datetime(2024, 1, 1), True)], "invite_id long, workspace long, created_at timestamp, claimed boolean")
    assert [r.invite_id for r in lifecycle.claimable(i, spark.createDataFrame([(6,)], "workspace long"), "2024-01-05", 7).collect()] == [1]


def test_only_runs_that_begin_a_name_are_shuffled(spark, monkeypatch):
    """Keys go out in broadcasts of a checked size; names that are a page's own alone are not looked for there."""
    runs = spark.createDataFrame([(i, i % 50) for i in range(500)], "from_page_id long, key long")
    keys = spark.createDataFrame([(k,) for k in (3, 7, 40, 99)], "key long")
    monkeypatch.setattr(links, "BROADCAST_KEYS", 2)
    got = links.begun(runs, keys)
    assert sorted((r.from_page_id, r.key) for r in got.collect()) == [(i, i % 50) for i in range(500) if i % 50 in (3, 7, 40)]
    pages = spark.createDataFrame([(1, "red apple tree", "a"), (2, "red apple tree", "b"), (3, "blue stone house", "c")], "page_id long, title string, slug string")
    bodies = spark.createDataFrame([(1, "a red apple tree"), (2, "no name"), (3, "blue stone house"), (4, "the blue stone house, red apple tree")], "page_id long, body string")
    found = sorted((r.from_page_id, r.to_page_id) for r in links.mentions(bodies, links.names(pages)).collect())
    assert found == [(1, 2), (4, 1), (4, 2), (4, 3)]


def test_exact_boost_of_blank_titles_equals_its_sql(spark, tmp_path):
    """Texts that begin with an empty line, hold blanks only, have other white space at a title's ends, or are missing."""
    import duckdb

    from palimpsest.plans.queries import ORACLE_SQL, QUERIES
    from tests.helpers import same

    texts = [(1, ""), (6, "\nbody"), (11, "  \nbody"), (16, "\t\nbody"), (21, None), (26, "Title\r\nbody"), (3, "Doc: 3\r\nbody"), (8, "doc: 8 \nbody"), (4, ""), (5, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert same(QUERIES["exact_boost"](spark, str(tmp_path)), con.execute(ORACLE_SQL["exact_boost"])) == len(texts)


@pytest.mark.parametrize("most", [2, 50])
def test_mentions_shuffle_no_text(spark, monkeypatch, most):
    """Equal to a plain search, with names in several broadcasts and small tiles; only links and names meet in a shuffle."""
    import random
    import re
    from types import SimpleNamespace

    import pyarrow as pa

    from palimpsest.operators import mentions as search

    pick = random.Random(5)
    words = ["a", "ab", "b1", "_b", "é", "b-a", "c++", "\\e", "(a)", "x.", "ab_", "ß", "a\n"]
    some = lambda most: " ".join(pick.choice(words) for _ in range(pick.randint(1, most)))
    titles, bodies = {i: some(6).strip() for i in range(60)}, {i: some(60) for i in range(80)} | {90: "", 91: None, 92: "abx ab"}
    want = []
    for i, body in bodies.items():
        found = []
        for to, name in titles.items():
            word = lambda c: bool(re.match("[A-Za-z0-9_]", c))
            ends = ("(?<!{})" if word(name[0]) else "(?<={})"), ("(?!{})" if word(name[-1]) else "(?={})")
            if to != i and re.search("[a-z0-9]", name) and re.search(ends[0].format("[A-Za-z0-9_]") + re.escape(name) + ends[1].format("[A-Za-z0-9_]"), body or ""):
                found.append((-len(name), to, name))
        want += [(i, to, name) for _, to, name in sorted(found)[:most]]
    named = spark.createDataFrame(list(titles.items()), "page_id long, name string")
    read = spark.createDataFrame(list(bodies.items()), "page_id long, body string")
    plan = links.mentions(read, named, most)._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("Exchange") <= 2
    monkeypatch.setattr(links, "BROADCAST_NAMES", 20)
    assert sorted(tuple(r) for r in links.mentions(read, named, most).collect()) == sorted(want)
    assert len(want) > 80
    monkeypatch.setattr(search, "TILE", 3)
    monkeypatch.setattr(search, "TEXT", 100)
    batch = pa.RecordBatch.from_pydict({"page_id": list(titles), "size": pa.array([len(n) for n in titles.values()], pa.int32()), "name": list(titles.values())})
    sent = SimpleNamespace(value=search.known(pa.Table.from_batches(search.hashed([batch]))))
    got = search.finder(sent, most)([pa.RecordBatch.from_pydict({"page_id": list(bodies), "body": list(bodies.values())})])
    assert sorted((*r.values(),) for b in got for r in b.to_pylist()) == sorted((i, to, len(name)) for i, to, name in want)


def test_capped_links_get_their_names_last(spark):
    pages = spark.createDataFrame([(1, "red apple tree", "a"), (2, "red apple tree", "a-slug-of-many-letters"), (3, "blue stone house", "c")], "page_id long, title string, slug string")
    bodies = spark.createDataFrame([(1, "a red apple tree, [x](/page/a-slug-of-many-letters#b)"), (4, "blue stone house, red apple tree [y](c) [z](a-slug-of-many-letters)")], "page_id long, body string")
    markdown, named = links.markdown_links(bodies, pages), links.names(pages)
    for most in (1, 2, 4, 50):
        got = links.capped(markdown, links.mentioned(bodies, named), most, named)
        want = links.capped(markdown, links.mentions(bodies, named), most)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert (4, 2, "markdown", "a-slug-of-many-letters") in set(map(tuple, got.collect())) and got.count() == 7
