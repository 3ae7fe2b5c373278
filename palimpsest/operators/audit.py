"""Censuses and drift counts of the corpus, session resolution, and what must not be retrieved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus_census(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pages (page_id, workspace, slug) with their number of chunks of the same workspace, 0 if none."""
    n = chunks.groupBy("page_id", "workspace").agg(F.count("*").alias("chunks"))
    return pages.join(n, ["page_id", "workspace"], "left").select("page_id", "workspace", "slug", F.coalesce("chunks", F.lit(0)).alias("chunks"))


def link_drift(links: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: links whose copies (from_acl, to_acl, from_deleted, to_deleted) differ from their pages', NULL counting, by column and in all."""
    j = links
    for end in ("from", "to"):
        p = pages.select(F.col("page_id").alias(f"{end}_page_id"), F.col("acl").alias(f"_{end}_acl"), F.col("deleted").alias(f"_{end}_deleted"))
        j = j.join(p, f"{end}_page_id")
    off = {c: ~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("from_acl", "to_acl", "from_deleted", "to_deleted")}
    anywhere = off["from_acl"] | off["to_acl"] | off["from_deleted"] | off["to_deleted"]
    return j.agg(F.count("*").alias("links"), *[F.count_if(x).alias(c) for c, x in off.items()], F.count_if(anywhere).alias("drifted"))


def resolve_sessions(sessions: DataFrame, principals: DataFrame, members: DataFrame, now) -> DataFrame:
    """(session_id, reason, principal_id, workspace_id, role) of sessions (session_id, principal_id, workspace, epoch, expires_at).

    The first reason that holds is given; who it is stays NULL for an expired or
    outdated session, and the workspace comes from the membership alone.
    """
    p = principals.select("principal_id", F.col("epoch").alias("_epoch"))
    m = members.select("principal_id", F.col("workspace_id").alias("workspace"), "role", F.lit(True).alias("_member"))
    j = sessions.join(p, "principal_id").join(m, ["principal_id", "workspace"], "left")
    late, old = F.col("expires_at") <= now, F.col("epoch") != F.col("_epoch")
    reason = F.when(late, "expired").when(old, "epoch_stale").when(F.col("workspace").isNull(), "no_active_ws").when(F.col("_member").isNull(), "membership_revoked").otherwise("ok")
    shown = lambda c, name: F.when(~late & ~old, c).alias(name)
    return j.select("session_id", reason.alias("reason"), shown(F.col("principal_id"), "principal_id"), shown(F.when(F.col("_member"), F.col("workspace")), "workspace_id"), shown(F.col("role"), "role"))


def leaks(retrieved: DataFrame, barred: DataFrame) -> DataFrame:
    """(qid, retrieved, leaked): rows (qid, slug) that a reader got, and how many are among the barred ones, (qid, slug) or slugs barred to all questions."""
    on = [c for c in ("qid", "slug") if c in barred.columns]
    marked = retrieved.join(barred.select(on).distinct().withColumn("_barred", F.lit(True)), on, "left")
    return marked.groupBy("qid").agg(F.count("*").alias("retrieved"), F.count("_barred").alias("leaked"))
