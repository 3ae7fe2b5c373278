"""Base tables and the frames that stand for knowledge-base pages, questions and facts.

The supplied tables have no tenancy, titles or dates; these frames derive them by
fixed rules, so that every operator has an input on which it matters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import all_terms, ascii_tokens, slugify


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, question, terms): the benchmark's whole texts, with all their distinct terms."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("qid"), F.col("text").alias("question"), all_terms(F.col("text"), 3).alias("terms"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, page_id, content, title, tokens, effective_date, author, workspace, acl, deleted): one chunk a document, four a page."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("chunk_id"),
        F.expr("doc_id div 4").alias("page_id"),
        F.col("text").alias("content"),
        F.substring_index("text", "\n", 1).alias("title"),
        ascii_tokens(F.col("text")).alias("tokens"),
        F.expr("date_add(DATE'2024-01-01', CAST(doc_id % 365 AS INT))").alias("effective_date"),
        F.concat(F.lit("Author-"), F.col("doc_id") % 7).alias("author"),
        F.col("source").alias("workspace"),
        F.when(F.col("doc_id") % 5 == 0, F.array(F.concat(F.lit("self:u"), F.col("doc_id") % 7))).otherwise(F.array(F.concat(F.lit("ws:"), F.col("source")))).alias("acl"),
        (F.col("doc_id") % 11 == 0).alias("deleted"),
    )


def kb_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a tenant: slug, title, access list, owner, date, deletion mark."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("page_id"),
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("slug"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("source").alias("workspace"),
        (F.col("doc_id") % 7).alias("owner"),
        F.when(F.col("doc_id") % 5 == 0, F.array(F.concat(F.lit("self:u"), F.col("doc_id") % 7))).otherwise(F.array(F.concat(F.lit("ws:"), F.col("source")))).alias("acl"),
        F.expr("date_add(DATE'2024-01-01', CAST(doc_id % 365 AS INT))").alias("effective_date"),
        (F.col("doc_id") % 11 == 0).alias("deleted"),
        F.col("text").alias("body"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fact_id, entity, vec): the vectors with their label as entity, and planted exact and near copies."""
    e = table(spark, sf_dir, "embeddings")
    base = e.select(F.col("vec_id").alias("fact_id"), F.col("label").alias("entity"), F.col("embedding").cast("array<double>").alias("vec"))
    copies = base.where("fact_id % 25 = 0").select((F.col("fact_id") + 1_000_000).alias("fact_id"), "entity", "vec")
    near = base.where("fact_id % 25 = 1").select((F.col("fact_id") + 1_000_000).alias("fact_id"), "entity", F.expr("transform(vec, (x, i) -> CASE WHEN i = 0 THEN x + 0.05D ELSE x END)").alias("vec"))
    return base.unionByName(copies).unionByName(near)


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", slugify(F.col("url")).alias("slug"))
