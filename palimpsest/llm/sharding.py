"""Sharding: proportional stratified interleaving, in DataFrame operations only.

Rows of each source are shuffled by a seeded hash and ranked; a row's
fractional rank is ``(rank + 1/2) / rows of its source``; all rows are ordered
by it and cut into consecutive runs, so every shard holds each source in the
proportion of the whole. Ranks are exact and distributed: rows are bucketed by
the leading hex digits of the hash (a hot source spreads over all buckets),
ranked inside a bucket, and shifted by the rows of the buckets before.

Defined results: a null text has size 1 and the checksum of the empty string; a
null source is a source of its own; a null id is hashed as the empty string;
repeated rows and equal texts are placed one by one; fewer rows than shards
leave the last shards empty; an empty table gives an empty result. Shards obey
the law ``rows``: their counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

DIGITS = 3  # 4,096 buckets, of each source's shuffle and of the fractional rank


def interleave(docs: DataFrame, shards: int = 8, seed: int = 20, id_col: str = "doc_id", source: str = "source", text: str = "text", digits: int = DIGITS, row: str | None = None) -> DataFrame:
    """``(id, src, size, text_crc32, row, shard, slot)`` of every row; row: a column that tells rows apart that are equal otherwise."""
    m = 16**digits
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.concat(F.lit("s:"), F.col(source)), F.lit("-")).alias("src"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        (F.col(row) if row else F.lit(0)).cast("long").alias("row"),
    )
    rows = rows.withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary")))
    rows = rows.withColumn("bucket", F.conv(F.substring("key", 1, digits), 16, 10).cast("int"))
    per = rows.groupBy("src", "bucket").agg(F.count("*").alias("n"))
    upto = W.partitionBy("src").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    per = per.select("src", "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"), F.sum("n").over(W.partitionBy("src")).alias("of"))
    inside = W.partitionBy("src", "bucket").orderBy("key", "id", "text_crc32", "size", "row")
    ranked = rows.join(per, ["src", "bucket"]).withColumn("rank", F.col("before") + F.row_number().over(inside) - 1)
    # (2 rank + 1) / (2 of): the slice is exact in whole numbers
    ranked = ranked.select("id", "src", "size", "text_crc32", "row", "key", ((2 * F.col("rank") + 1) / (2 * F.col("of"))).alias("frac"), F.expr(f"(2 * rank + 1) * {m}L div (2 * of)").alias("slice"))
    sizes = ranked.groupBy("slice").agg(F.count("*").alias("n"))  # at most m rows
    sizes = sizes.select("slice", F.coalesce(F.sum("n").over(W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"), F.sum("n").over(W.orderBy("slice").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("total"))
    order = W.partitionBy("slice").orderBy("frac", "src", "key", "id", "text_crc32", "size", "row")
    placed = ranked.join(F.broadcast(sizes), "slice").withColumn("at", F.col("ahead") + F.row_number().over(order) - 1)
    q, r = f"(total div {shards})", f"(total % {shards})"
    shard = f"CASE WHEN at < {r} * ({q} + 1) THEN at div ({q} + 1) ELSE {r} + (at - {r} * ({q} + 1)) div greatest({q}, 1L) END"
    placed = placed.withColumn("shard", F.expr(shard).cast("int"))
    first = f"(shard * {q} + least(shard, {r}))"
    return placed.select("id", "src", "size", "text_crc32", "row", "shard", F.expr(f"at - {first}").cast("long").alias("slot"))


def shard_table(docs: DataFrame, shards: int = 8, **options) -> DataFrame:
    """The digest of ``interleave``, one row for each document."""
    out = interleave(docs, shards, **options)
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, **options) -> None:
    """Writes whole rows as ``path/shard=k``, each shard in slot order over files of its own.

    Rows go through ``interleave`` with a number of their own, so rows of equal
    ids take a place each; a column of docs named ``shard`` or ``slot``, in any case, gets
    as many ``_`` behind its name as no other column's name needs.
    """
    from palimpsest.llm.scratch import Scratch

    scratch = Scratch(docs.sparkSession, "shards")
    taken = {c.lower() for c in docs.columns}
    names = {}
    for c in docs.columns:
        name = c
        while c.lower() in ("shard", "slot") and name.lower() in taken:
            name += "_"
        names[c] = name
        taken.add(name.lower())
    number = "_row"
    while number in taken:
        number += "_"
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    options = {k: names.get(v, v) if k in ("id_col", "source", "text") else v for k, v in options.items()}
    rows = scratch.save(renamed.withColumn(number, F.monotonically_increasing_id()), "rows")  # saved, so the numbers stay
    where = interleave(rows, shards, row=number, **options).select(F.col("row").alias(number), "shard", "slot")
    full = rows.join(where, number).drop(number)
    full.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
    scratch.drop("rows")
