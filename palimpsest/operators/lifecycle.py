"""Listing, deletion, rescoping, purging and the ledgers of change.

Mutations yield the outcome of every asked id and, where asked, the next state;
nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.access import visible


def page_listing(pages: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first, ties by id, with whether more follow."""
    some = pages.orderBy(F.desc("effective_date"), F.asc("page_id")).offset(offset).limit(limit + 1)
    n = F.broadcast(some.agg((F.count("*") > limit).alias("has_more")))  # one row
    return some.orderBy(F.desc("effective_date"), F.asc("page_id")).limit(limit).crossJoin(n)


def has_source(pages: DataFrame, sources: DataFrame) -> DataFrame:
    mark = sources.select("page_id").distinct().withColumn("has_source", F.lit(True))
    return pages.join(mark, "page_id", "left").withColumn("has_source", F.coalesce("has_source", F.lit(False)))


def chunk_counts(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    n = chunks.groupBy("page_id").agg(F.count("*").alias("chunk_count"))
    return pages.join(n, "page_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


def page_text(chunks: DataFrame) -> DataFrame:
    """(page_id, text): a page put together from its chunks in order, at most a million characters, with a mark if cut."""
    t = chunks.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "content"))), lambda x: x["content"]), "\n").alias("text"))
    return t.select("page_id", F.substring("text", 1, 1_000_000).alias("text"), (F.length("text") > 1_000_000).alias("truncated"))


def _asked(pages: DataFrame, ids: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    seen = visible(pages, tags).select("page_id", "owner", "acl", "slug")
    return ids.join(seen, ids["id"] == seen["page_id"], "left")


def delete_outcomes(pages: DataFrame, ids: DataFrame, tags: tuple[str, ...], user: int) -> DataFrame:
    """(id, outcome) of each asked id: ok, not_visible or not_author."""
    out = F.when(F.col("page_id").isNull(), "not_visible").when(F.col("owner") != user, "not_author").otherwise("ok")
    return _asked(pages, ids, tags).select("id", out.alias("outcome"))


def soft_delete(rows: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Pages, chunks, facts or sources (page_id, deleted) after the deletion."""
    gone = outcomes.where("outcome = 'ok'").select(F.col("id").alias("page_id")).distinct().withColumn("_gone", F.lit(True))
    return rows.join(gone, "page_id", "left").withColumn("deleted", F.col("deleted") | F.coalesce("_gone", F.lit(False))).drop("_gone")


def rescope_outcomes(pages: DataFrame, ids: DataFrame, tags: tuple[str, ...], user: int, acl: Column, taken: DataFrame) -> DataFrame:
    """(id, outcome): also unchanged if the list is that already, and collision if the slug is taken in the new scope."""
    t = taken.select("slug").distinct().withColumn("_taken", F.lit(True))
    j = _asked(pages, ids, tags).join(t, "slug", "left")
    out = F.when(F.col("page_id").isNull(), "not_visible").when(F.col("owner") != user, "not_author").when(F.col("acl") == acl, "unchanged").when(F.col("_taken"), "collision").otherwise("ok")
    return j.select("id", out.alias("outcome"))


def purge_counts(pages: DataFrame, today: str, grace_days: int = 30) -> DataFrame:
    due = pages.where(F.col("deleted") & (F.col("effective_date") < F.date_sub(F.to_date(F.lit(today)), grace_days)))
    return due.groupBy("workspace").agg(F.count("*").alias("due"))


def purge(rows: DataFrame, due: DataFrame) -> DataFrame:
    return rows.join(due.select("page_id").distinct(), "page_id", "left_anti")


def changed_since(rows: DataFrame, after: int, limit: int) -> DataFrame:
    """Rows whose stamp is not their content hash, from the key on, in key order."""
    return rows.where((F.col("doc_id") > after) & ~F.col("stamp").eqNullSafe(F.col("content_hash"))).orderBy("doc_id").limit(limit)


def migration_ledger(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """(id, state): pending, orphan, drifted or applied, from files and ledger (id, sum)."""
    a, b = files.select("id", F.col("sum").alias("f")), ledger.select("id", F.col("sum").alias("l"))
    state = F.when(F.col("l").isNull(), "pending").when(F.col("f").isNull(), "orphan").when(F.col("f") != F.col("l"), "drifted").otherwise("applied")
    return a.join(b, "id", "full").select("id", state.alias("state"))


def claimable(invites: DataFrame, blocked: DataFrame, now: str, days: int) -> DataFrame:
    """Unclaimed invites within their time whose workspace is not blocked."""
    live = invites.where(~F.col("claimed") & (F.col("created_at") + F.make_dt_interval(F.lit(days)) > F.to_timestamp(F.lit(now))))
    return live.join(blocked.select("workspace").distinct(), "workspace", "left_anti")


def resolve_slug(pages: DataFrame, slugs: DataFrame) -> DataFrame:
    """(slug, page_id, outcome) of asked slugs: ok, not_found or ambiguous."""
    n = pages.groupBy("slug").agg(F.count("*").alias("n"), F.min("page_id").alias("page_id"))
    j = slugs.join(n, "slug", "left")
    out = F.when(F.col("n").isNull(), "not_found").when(F.col("n") > 1, "ambiguous").otherwise("ok")
    return j.select("slug", F.when(F.col("n") == 1, F.col("page_id")).alias("page_id"), out.alias("outcome"))


def replace_outcomes(pages: DataFrame, edits: DataFrame, sources: DataFrame, tags: tuple[str, ...], user: int) -> DataFrame:
    """(id, outcome) of edits (id, body): not_visible, not_author, has_source (a file's page), no_text, or ok."""
    filed = sources.select(F.col("page_id").alias("id")).distinct().withColumn("_filed", F.lit(True))
    told = edits.select("id", F.coalesce(~F.col("body").rlike("[^\\s]"), F.lit(True)).alias("_blank"))  # bodies stay where they are
    j = _asked(pages, told.join(filed, "id", "left"), tags)  # by id: the pages not seen have no page_id, and would all meet in one task
    out = F.when(F.col("page_id").isNull(), "not_visible").when(F.col("owner") != user, "not_author").when(F.col("_filed"), "has_source").when(F.col("_blank"), "no_text").otherwise("ok")
    return j.select("id", out.alias("outcome"))


def _taken(edits: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The edits that take effect; of several for one page, the least by text."""
    return edits.join(outcomes.where("outcome = 'ok'").select("id").distinct(), "id", "left_semi").groupBy(F.col("id").alias("page_id")).agg(F.min(F.struct("body", "title")).alias("_e"))


def replaced_pages(pages: DataFrame, edits: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Pages after the edits (id, body, title): new body, hash and time; a NULL title and all labels stay."""
    j, new = pages.join(_taken(edits, outcomes), "page_id", "left"), F.col("_e").isNotNull()
    next_ = {"body": F.col("_e.body"), "title": F.coalesce("_e.title", "title"), "content_hash": F.sha2("_e.body", 256), "updated_at": now}
    return j.select(*[F.when(new, next_[c]).otherwise(F.col(c)).alias(c) if c in next_ else F.col(c) for c in pages.columns])


def replaced_chunks(chunks: DataFrame, pages: DataFrame, edits: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Chunks (page_id, ord, content, acl, effective_date, author) after the edits: new ones carry their page's labels."""
    from palimpsest.operators.chunking import chunk_documents

    taken = _taken(edits, outcomes)
    new = chunk_documents(taken.select("page_id", F.col("_e.body").alias("body")), "page_id", "body")
    labels = pages.select("page_id", "acl", "effective_date", "author")
    made = new.join(labels.withColumnRenamed("page_id", "doc_id"), "doc_id").select(F.col("doc_id").alias("page_id"), "ord", "content", "acl", "effective_date", "author")
    return chunks.select(*made.columns).join(taken.select("page_id"), "page_id", "left_anti").unionByName(made)
