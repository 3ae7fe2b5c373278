"""Readers of evaluation datasets: corpora and questions in JSON, CSV, JSONL and calendar files.

Each returns documents ``(id, title, body, ...)`` or questions ``(qid, question, answer, gold)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import slugify

EVIDENCE = "array<struct<url:string,title:string,fact:string>>"


def news_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One JSON array of articles; the author may be missing."""
    schema = "title string, author string, source string, published_at string, category string, url string, body string"
    d = spark.read.schema(schema).json(path, multiLine=True)
    return d.withColumn("slug", slugify(F.col("url"))).withColumn("effective_date", F.try_to_date(F.substring("published_at", 1, 10)))


def news_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions with their distinct evidence urls as gold."""
    q = spark.read.schema(f"query string, answer string, question_type string, evidence_list {EVIDENCE}").json(path, multiLine=True)
    gold = F.array_distinct(F.transform("evidence_list", lambda e: slugify(e["url"])))
    return q.select(F.sha2("query", 256).alias("qid"), F.col("query").alias("question"), "answer", "question_type", F.coalesce(gold, F.array().cast("array<string>")).alias("gold"))


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"')


def csv_documents(spark: SparkSession, path: str, most_chars: int = 195_000) -> DataFrame:
    d = _csv(spark, path, "index int, source_url string, text string")
    return d.select("index", F.col("source_url").alias("url"), F.substring_index("text", "\n", 1).alias("title"), F.substring("text", 1, most_chars).alias("body"), slugify(F.col("source_url")).alias("slug"))


def csv_questions(spark: SparkSession, path: str, documents: DataFrame, kind: str) -> DataFrame:
    """Questions of known documents only; without an answer column they are unanswerable, with empty gold."""
    answered = kind != "no_answer"
    q = _csv(spark, path, "document_index int, question string" + (", answer string" if answered else ""))
    j = q.join(documents.select(F.col("index").alias("document_index"), "slug"), "document_index")
    gold = F.array("slug") if answered else F.array().cast("array<string>")
    return j.select("question", (F.col("answer") if answered else F.lit(None).cast("string")).alias("answer"), F.lit(kind).alias("question_type"), gold.alias("gold"))


def unknown_documents(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """Questions whose document doesn't exist."""
    return questions.join(documents.select(F.col("index").alias("document_index")), "document_index", "left_anti")


def memory_cases(spark: SparkSession, path: str) -> DataFrame:
    """(question_id, session_id, session, turn, role, content) of conversational cases; blank turns go, equal repeated sessions collapse."""
    turn = "struct<role:string,content:string>"
    d = spark.read.schema(f"question_id string, question_type string, question string, answer string, haystack_session_ids array<string>, haystack_sessions array<array<{turn}>>, answer_session_ids array<string>").json(path, multiLine=True)
    s = d.select("question_id", F.posexplode(F.arrays_zip("haystack_session_ids", "haystack_sessions")).alias("session", "z"))
    s = s.select("question_id", "session", F.col("z.haystack_session_ids").alias("session_id"), F.col("z.haystack_sessions").alias("turns"))
    s = s.groupBy("question_id", "session_id", "turns").agg(F.min("session").alias("session"))
    t = s.select("question_id", "session_id", "session", F.posexplode("turns").alias("turn", "t"))
    return t.select("question_id", "session_id", "session", "turn", "t.role", "t.content").where(F.trim("content") != "")


def conflicting_sessions(cases: DataFrame) -> DataFrame:
    """Sessions that come with two different bodies in one case."""
    return cases.groupBy("question_id", "session_id").agg(F.count_distinct("session").alias("n")).where("n > 1")


def messages(spark: SparkSession, path: str, schema: str = "slug string, subject string, `from` string, `to` array<string>, ts string, body_text string") -> DataFrame:
    """Mail or chat, a JSON object a line."""
    return spark.read.schema(schema).json(path)


def calendar_events(files: DataFrame, text: str = "value") -> DataFrame:
    """(uid, summary, start) of the events in whole calendar files; folded lines are joined."""
    flat = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\n[ \t]", "")
    e = files.select(F.explode(F.regexp_extract_all(flat, F.lit(r"(?s)BEGIN:VEVENT\n(.*?)END:VEVENT"), 1)).alias("e"))
    line = lambda k: F.nullif(F.regexp_extract("e", rf"(?m)^{k}(?:;[^:\n]*)?:(.*)$", 1), F.lit(""))
    return e.select(line("UID").alias("uid"), line("SUMMARY").alias("summary"), line("DTSTART").alias("start"))


def walk(spark: SparkSession, path: str, ignored: tuple[str, ...] = (".git", "node_modules", "dist")) -> DataFrame:
    """Files below a folder with their bytes, without ignored folders."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.where(~F.col("path").rlike("/(" + "|".join(d.replace(".", "\\.") for d in ignored) + ")/"))


LOADERS = {"news": (news_corpus, news_questions), "csv": (csv_documents, csv_questions), "memory": (memory_cases, None)}
