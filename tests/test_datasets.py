import json

from pyspark.sql import functions as F

from palimpsest.operators import serving
from palimpsest.sources import datasets as D


def test_news(spark, tmp_path):
    docs = [{"title": "T", "author": None, "source": "S", "published_at": "2023-09-01T10:00:00+00:00", "category": "c", "url": "https://www.x.com/a", "body": "b"}, {"title": "U", "url": "https://y.com/", "published_at": "soon", "body": "c"}]
    qa = [{"query": "q", "answer": "Yes", "question_type": "inference", "evidence_list": [{"url": "https://www.x.com/a"}, {"url": "https://x.com/a"}, {"url": "https://y.com/"}]}, {"query": "r", "answer": "Insufficient information.", "question_type": "null", "evidence_list": []}]
    (tmp_path / "c.json").write_text(json.dumps(docs))
    (tmp_path / "q.json").write_text(json.dumps(qa))
    c = D.news_corpus(spark, str(tmp_path / "c.json")).orderBy("title").collect()
    assert [(r.slug, str(r.effective_date)) for r in c] == [("x-com-a", "2023-09-01"), ("y-com", "None")]
    q = {r.question: r.gold for r in D.news_questions(spark, str(tmp_path / "q.json")).collect()}
    assert q == {"q": ["x-com-a", "y-com"], "r": []}


def test_csv(spark, tmp_path):
    (tmp_path / "d.csv").write_text('index,source_url,text\n0,https://a.b/c,"First line\nsaid ""this"", and more"\n1,https://a.b/d,Other\n')
    (tmp_path / "s.csv").write_text("document_index,question,answer\n0,What?,This\n9,Lost?,No\n")
    (tmp_path / "n.csv").write_text("document_index,question\n1,Unknown?\n")
    docs = D.csv_documents(spark, str(tmp_path / "d.csv"))
    assert [(r.title, r.slug) for r in docs.orderBy("index").collect()] == [("First line", "a-b-c"), ("Other", "a-b-d")]
    assert [(r.question, r.gold) for r in D.csv_questions(spark, str(tmp_path / "s.csv"), docs, "single").collect()] == [("What?", ["a-b-c"])]
    assert [(r.answer, r.gold) for r in D.csv_questions(spark, str(tmp_path / "n.csv"), docs, "no_answer").collect()] == [(None, [])]
    asked = spark.read.csv(str(tmp_path / "s.csv"), header=True, inferSchema=True)
    assert [r.document_index for r in D.unknown_documents(asked, docs).collect()] == [9]


def test_memory(spark, tmp_path):
    turns = [{"role": "user", "content": "a"}, {"role": "assistant", "content": " "}]
    case = {"question_id": "1", "question_type": "t", "question": "q", "answer": 3, "haystack_session_ids": ["s", "s", "u", "u"], "haystack_sessions": [turns, turns, turns, [{"role": "user", "content": "other"}]], "answer_session_ids": ["s"]}
    (tmp_path / "m.json").write_text(json.dumps([case]))
    got = D.memory_cases(spark, str(tmp_path / "m.json"))
    assert sorted((r.session_id, r.content) for r in got.collect()) == [("s", "a"), ("u", "a"), ("u", "other")]
    assert [r.session_id for r in D.conflicting_sessions(got).collect()] == ["u"]


def test_calendar_and_walk(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "a/x.ics").write_bytes(b"BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:1\r\nSUMMARY;LANG=en:Long\r\n  title\r\nDTSTART:20240101\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:2\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n")
    (tmp_path / ".git/y.ics").write_bytes(b"x")
    files = D.walk(spark, str(tmp_path))
    assert files.count() == 1
    e = D.calendar_events(files.select(F.decode("content", "UTF-8").alias("value"))).orderBy("uid").collect()
    assert [(r.uid, r.summary, r.start) for r in e] == [("1", "Long title", "20240101"), ("2", None, None)]


def test_serving_by_hand(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(serving.scrub_markers(F.lit("a [1] b[3] [99999999999] c[2]"), F.lit(2))) == "a [1] b  c[2]"
    assert one(serving.clamp_citations(F.array(*map(F.lit, [0, 1, 2, 2, 9])), F.lit(2))) == [1, 2]
    r = one(serving.redact(F.create_map(F.lit("q"), F.lit("x" * 2000), F.lit("z"), F.lit("")), ("q", "k")))
    assert (r.declared, r.unknown, r.bytes) == (["q"], 1, 2048)
    assert one(serving.token_cost(F.lit(1000), F.lit(10), F.lit("m"), {"m": (3.0, 15.0)})) == 0.00315
    items = spark.createDataFrame([("p", i, t) for i, t in enumerate([5, 5, 5, 30, 1])], "part string, seq int, tokens int")
    assert [r["count"] for r in serving.plan_batches(items, 2, 10).groupBy("batch").count().orderBy("batch").collect()] == [2, 1, 1, 1]
    top = spark.createDataFrame([(1, 1, "a#b", 0), (1, 2, "c", 3)], "qid long, rank int, slug string, ord int")
    assert sorted(serving.read_snapshot(serving.snapshot(top)).collect()) == sorted(top.collect())
