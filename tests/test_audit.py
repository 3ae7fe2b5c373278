"""Audits, packing, splits and edits on small tables, held against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import audit, evaluation, lifecycle, parsing, screening, serving


@pytest.mark.parametrize("p", [0.001, 0.3, 0.5, 0.95, 1.0])
def test_nearest_rank_with_ties_and_nulls(spark, p, monkeypatch):
    rnd = random.Random(3)
    rows = [(part, rnd.choice([1.0, 2.0, 2.0, rnd.random() * 9])) for part in "abc" for _ in range({"a": 1, "b": 40, "c": 5000}[part])]
    df = spark.createDataFrame([*rows, ("a", None), (None, 4.0)], "part string, v double").repartition(4)
    got = {r.part: r.value for r in evaluation.nearest_rank(df, "part", "v", p).collect()}
    by = {k: sorted(v for q, v in rows if q == k) for k in "abc"} | {None: [4.0]}
    assert got == {k: v[max(1, math.ceil(p * len(v))) - 1] for k, v in by.items()}


def test_upper_median(spark):
    df = spark.createDataFrame([("a", x) for x in (5, 1, 9, 7)] + [("b", 3)], "part string, v long")
    got = {r.part: (r.least, r.median, r.greatest, r.n) for r in evaluation.timings(df, "part", "v").collect()}
    assert got == {"a": (1, 7, 9, 4), "b": (3, 3, 3, 1)}


def test_split_is_independent_of_order_and_keeps_shares(spark):
    rows = [(i, None if i % 7 == 0 else "ab"[i % 2], i % 3) for i in range(501)]
    df = spark.createDataFrame(rows, "qid long, type string, hops int")
    one = {r.qid: r.side for r in evaluation.joint_split(df).collect()}
    two = {r.qid: r.side for r in evaluation.joint_split(df.orderBy(F.desc("qid")).repartition(5)).collect()}
    assert one == two and len(one) == 501
    assert sum(s == "tuning" for s in one.values()) == math.floor(501 * 0.7 + 0.5)
    groups = {}
    for q, t, h in rows:
        groups.setdefault((t, h), []).append(one[q] == "tuning")
    assert all(abs(sum(g) - 0.7 * len(g)) < 1 for g in groups.values())
    assert evaluation.joint_split(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        evaluation.joint_split(df, 1.5)


def test_packing_limits(spark):
    rnd = random.Random(1)
    rows = [(p, i, rnd.choice([0, 1, 5, 90, 400])) for p in "xy" for i in range(200)]
    df = spark.createDataFrame(rows, "part string, seq long, tokens long").repartition(3)
    for got, most, weighed in ((serving.plan_batches(df, 10, 100), 10, False), (serving.plan_updates(df, 100), 10**9, True)):
        want, state = {}, {}
        for p, i, w in rows:
            k, n, s = state.get(p, (0, 0, 0))
            if n >= most or ((s if weighed else n) > 0 and s + w > 100):
                k, n, s = k + 1, 0, 0
            state[p] = (k, n + 1, s + w)
            want[p, i] = k
        assert {(r.part, r.seq): r.batch for r in got.collect()} == want


def test_cap_bound_of_one_list(spark):
    rows = spark.createDataFrame([(1, 8, 0.5, 4), (1, 12, 0.75, 6), (1, 4, 0.25, 2), (2, 8, None, 8), (3, 8, 1.0, 8)], "qid long, k int, recall double, docs int")
    r = evaluation.cap_bound(rows, 8, 2).first()
    assert (r.baseline, r.bound, r.n, r.mean_docs, r.ceiling_docs) == (0.75, 0.875, 2, 6.0, 7.0)


def test_sessions_say_who_only_when_valid(spark):
    s = spark.createDataFrame([(1, 7, "w", 1, "2030-01-01"), (2, 7, "w", 1, "2020-01-01"), (3, 7, "w", 0, "2030-01-01"), (4, 7, None, 1, "2030-01-01"), (5, 7, "v", 1, "2030-01-01"), (6, 8, "w", 1, "2030-01-01")], "session_id long, principal_id long, workspace string, epoch int, expires_at string")
    p = spark.createDataFrame([(7, 1)], "principal_id long, epoch int")
    m = spark.createDataFrame([(7, "w", "admin")], "principal_id long, workspace_id string, role string")
    got = [tuple(r) for r in audit.resolve_sessions(s.withColumn("expires_at", F.to_timestamp("expires_at")), p, m, F.lit("2025-01-01").cast("timestamp")).orderBy("session_id").collect()]
    assert got == [(1, "ok", 7, "w", "admin"), (2, "expired", None, None, None), (3, "epoch_stale", None, None, None), (4, "no_active_ws", 7, None, None), (5, "membership_revoked", 7, None, None)]


def test_leaks_are_seen(spark):
    got = audit.leaks(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "qid long, slug string"), spark.createDataFrame([(1, "b"), (1, "b"), (2, "a")], "qid long, slug string"))
    assert {tuple(r) for r in got.collect()} == {(1, 2, 1), (2, 1, 0)}
    got = audit.leaks(spark.createDataFrame([(1, "a"), (2, "a"), (2, "c")], "qid long, slug string"), spark.createDataFrame([("a",)], "slug string"))
    assert {tuple(r) for r in got.collect()} == {(1, 1, 1), (2, 2, 1)}


def test_replaced_chunks_carry_labels(spark):
    pages = spark.createDataFrame([(1, "ws:a", 3, "s1"), (2, "ws:a", 3, "s2"), (3, "ws:b", 3, "s3"), (4, "ws:a", 9, "s4"), (5, "ws:a", 3, "s5")], "page_id long, tag string, owner long, slug string")
    pages = pages.select("page_id", F.array("tag").alias("acl"), "owner", "slug", F.lit(False).alias("deleted"), F.lit("2024-01-01").alias("effective_date"), F.lit("me").alias("author"))
    edits = spark.createDataFrame([(1, "fresh words here", None), (2, " \n", None), (3, "x", None), (4, "x", None), (5, "x", None), (6, "x", None)], "id long, body string, title string")
    out = lifecycle.replace_outcomes(pages, edits, spark.createDataFrame([(5,)], "page_id long"), ("ws:a",), 3)
    assert {tuple(r) for r in out.collect()} == {(1, "ok"), (2, "no_text"), (3, "not_visible"), (4, "not_author"), (5, "has_source"), (6, "not_visible")}
    old = spark.createDataFrame([(1, 0, "old"), (1, 1, "old too"), (2, 0, "stays")], "page_id long, ord int, content string")
    old = old.select("*", F.array(F.lit("ws:old")).alias("acl"), F.lit("2023-01-01").alias("effective_date"), F.lit("other").alias("author"))
    got = sorted((r.page_id, r.ord, r.content, r.acl, r.author) for r in lifecycle.replaced_chunks(old, pages, edits, out).collect())
    assert got == [(1, 0, "fresh words here", ["ws:a"], "me"), (2, 0, "stays", ["ws:old"], "other")]


def test_answers_by_hand(spark):
    raw = ['{"answer": "a[1][7]", "citations": [2, 2, 0, 1.5, "1", 9, 1]}', '```\n{"answer": "b"}\n```', '{"answer": 5, "citations": [1]}', "plain [1][5]", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string").select("i", serving.parse_answer(F.col("raw"), F.lit(3)).alias("p")).orderBy("i")
    assert [tuple(r.p) for r in df.collect()] == [("a[1]", [2, 1], False), ("b", [], False), (raw[2], [], True), ("plain [1]", [], True), (None, [], True)]


def test_frames_and_names(spark):
    df = spark.createDataFrame([("a\x07b\r\nc\rd\u2028--N1--",)], "t string").select(
        T.without_hazards(F.col("t"), F.lit("N1")), T.safe_slug(F.lit("a b/N1"), F.lit("N1")), T.safe_slug(F.lit(""), F.lit("N1")), T.safe_locator(F.lit('Q3!A1:B2" x'), F.lit("N1")), T.slug_of_file(F.lit("/x/My Report.v2.pdf")), T.slug_of_file(F.lit("c:\\d\\.env"))
    )
    assert tuple(df.first()) == ("a b\nc\nd --**--", "a-b---", "untitled", "Q3!A1:B2--x", "my-report-v2", "env")


@pytest.mark.parametrize(("content", "kind"), [(b"\x10\x0a\x00", "unsupported"), (b"a\x01" * 10, "unsupported"), (b"text " * 30 + b"\x01", "text"), (b"", "text"), (b"<headless>", "text"), (b"<HEAD >", "html")])
def test_textual_bytes(spark, content, kind):
    assert spark.createDataFrame([(bytearray(content), "f")], "c binary, n string").select(parsing.detect_format(F.col("c"), F.col("n"))).first()[0] == kind


def test_remedies(spark):
    got = spark.createDataFrame([("old Word (.doc)",), (None,)], "t string").select(parsing.remediation(F.col("t"))).collect()
    assert "docx" in got[0][0] and got[1][0].startswith("Supported")


def test_fingerprint_is_independent_of_order(spark):
    rows = [("a", f"text {i}") for i in range(50)] + [("b", None)]
    one, two = (spark.createDataFrame(r, "part string, t string") for r in (rows, rows[::-1]))
    at = lambda df: sorted(map(tuple, screening.fingerprints(df, "part", "t").collect()))
    assert at(one) == at(two) and at(one)[1][2] == 1
    assert at(one) != at(one.where("t IS NULL OR t <> 'text 3'"))


def test_replace_outcomes_deal_neither_bodies_nor_missing_pages(spark):
    """Edits of pages that nobody sees spread by their ids, and no body is shuffled."""
    from pyspark.sql import functions as F

    from palimpsest.operators import lifecycle

    pages = spark.range(4).select(F.col("id").alias("page_id"), F.lit(3).alias("owner"), F.array(F.lit("ws:a")).alias("acl"), F.lit("s").alias("slug"), F.lit(False).alias("deleted"))
    edits = spark.range(40).select("id", F.when(F.col("id") == 1, F.lit(None)).when(F.col("id") == 2, " \n").otherwise(F.lit("long text")).alias("body"))
    out = lifecycle.replace_outcomes(pages, edits, spark.range(3, 9).select(F.col("id").alias("page_id")), ("ws:a",), 3)
    got = {r.id: r.outcome for r in out.collect()}
    assert got == {i: ("ok", "no_text", "no_text", "has_source")[i] if i < 4 else "not_visible" for i in range(40)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joins = plan[: plan.index("_blank")]
    assert "body" not in joins and plan.count("Join LeftOuter, (page_id") == 0  # before, both joins carried bodies and the second went by page_id
