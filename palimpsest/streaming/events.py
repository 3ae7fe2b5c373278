"""Event-time windows, late data and incremental ingest, as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, late: str | None = None) -> DataFrame:
    """Events with an instant as their time (files may hold it without zone), and a watermark if one is given."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late) if late else events


def tumbling(events: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(start, event_type, n, total) of windows; works on streams with a watermark and on tables."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    g = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events once each, within the watermark on streams."""
    if events.isStreaming:
        return timed(events, late).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


def ingest(docs: DataFrame, path: str, checkpoint: str):
    """A running query that turns new documents into chunks and postings under path, each batch once."""
    from palimpsest.functions.text import ascii_tokens
    from palimpsest.operators.chunking import chunk_documents
    from palimpsest.operators.screening import junk_gate

    def batch(df: DataFrame, number: int) -> None:
        good = junk_gate(df).where("verdict = 'ok'").drop("verdict")
        chunks = chunk_documents(good)
        chunks.write.mode("overwrite").parquet(f"{path}/chunks/batch={number}")
        saved = df.sparkSession.read.schema(chunks.schema).parquet(f"{path}/chunks/batch={number}")
        terms = saved.select("doc_id", "ord", F.explode(ascii_tokens(F.col("content"))).alias("term"))
        terms.groupBy("term", "doc_id", "ord").agg(F.count("*").alias("tf")).write.mode("overwrite").parquet(f"{path}/postings/batch={number}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
