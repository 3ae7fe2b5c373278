from pyspark.sql import functions as F

from palimpsest.streaming import events as S


def test_stream_equals_table(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/events.parquet")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = S.tumbling(S.timed(stream, "40 days")).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.start, r.event_type): r.n for r in spark.table("windows").collect()}
    assert got == {(r.start, r.event_type): r.n for r in S.tumbling(S.timed(table)).collect()}


def test_late_duplicates_go(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/events.parquet")
    table.unionByName(table).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = S.deduplicated(stream, "40 days").writeStream.format("memory").queryName("once").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == table.count()


def test_ingest_in_steps(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    source = str(tmp_path / "in")
    stream = lambda: spark.readStream.schema(docs.schema).parquet(source)
    for part in (0, 1):
        docs.where(F.col("doc_id") % 2 == part).coalesce(1).write.mode("append").parquet(source)
        S.ingest(stream(), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    from palimpsest.operators.chunking import chunk_documents
    from palimpsest.operators.screening import junk_gate

    want = chunk_documents(junk_gate(docs).where("verdict = 'ok'")).count()
    assert spark.read.parquet(str(tmp_path / "out/chunks")).count() == want
    assert spark.read.parquet(str(tmp_path / "out/postings")).where("tf < 1").count() == 0
