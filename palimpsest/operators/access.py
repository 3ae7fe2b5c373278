"""Row visibility, edges between visible pages, and audits of access lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = "^(self|ws|team|role):[A-Za-z0-9_-]+$"
ROLES = {"member": 1, "admin": 2, "owner": 3}


def grants(tags: tuple[str, ...]):
    """The request's keyring as a literal; a malformed tag grants nothing."""
    import re

    return F.array(*[F.lit(t) for t in tags if re.match(TAG, t)]).cast("array<string>")


def visible(df: DataFrame, tags: tuple[str, ...], live: str = "deleted") -> DataFrame:
    """Rows whose access list meets the keyring and that are not deleted; NULL lists stay hidden."""
    df = df.where(F.coalesce(F.arrays_overlap("acl", grants(tags)), F.lit(False)))
    return df.where(~F.col(live)) if live in df.columns else df


def visible_edges(edges: DataFrame, pages: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """Edges (from_page_id, to_page_id) both of whose ends are visible and live."""
    ok = visible(pages, tags).select("page_id")
    e = edges.join(ok.withColumnRenamed("page_id", "from_page_id"), "from_page_id", "left_semi")
    return e.join(ok.withColumnRenamed("page_id", "to_page_id"), "to_page_id", "left_semi").select("from_page_id", "to_page_id")


def keyring(users: DataFrame, extra: DataFrame) -> DataFrame:
    """(user_id, keyring): self and workspace tags and the distinct extra tags of users (user_id, workspace)."""
    more = extra.groupBy("user_id").agg(F.collect_set("tag").alias("tags"))
    own = F.array(F.concat(F.lit("self:u"), "user_id"), F.concat(F.lit("ws:"), "workspace"))
    return users.join(more, "user_id", "left").select("user_id", F.array_union(own, F.coalesce("tags", F.array().cast("array<string>"))).alias("keyring"))


def census(rows: DataFrame, part: str) -> DataFrame:
    """Tags in all, malformed ones, and those that no request can be granted (team, role), by part."""
    t = rows.select(part, F.explode("acl").alias("tag"))
    return t.groupBy(part).agg(F.count("*").alias("total"), F.count_if(~F.col("tag").rlike(TAG)).alias("malformed"), F.count_if(F.col("tag").rlike("^(team|role):")).alias("unmintable"))


def drift(children: DataFrame, pages: DataFrame) -> DataFrame:
    """Children (page_id, acl) with their page's workspace and whether their list differs from the page's, NULL counting."""
    p = pages.select("page_id", "workspace", F.col("acl").alias("page_acl"))
    return children.join(p, "page_id").withColumn("drifted", ~F.col("acl").eqNullSafe(F.col("page_acl")))


def propagate(children: DataFrame, pages: DataFrame) -> DataFrame:
    """Children with their pages' access list and deletion mark."""
    p = pages.select("page_id", F.col("acl").alias("_acl"), F.col("deleted").alias("_deleted"))
    kept = [c for c in children.columns if c not in ("acl", "deleted")]
    return children.join(p, "page_id").select(*kept, F.col("_acl").alias("acl"), F.col("_deleted").alias("deleted"))


def scope_agreement(pages: DataFrame) -> DataFrame:
    """Pages whose scope, list and owner disagree: private means exactly the owner's tag, else exactly the workspace's."""
    want = F.when(F.col("scope") == "private", F.array(F.concat(F.lit("self:u"), "owner"))).otherwise(F.array(F.concat(F.lit("ws:"), "workspace")))
    return pages.where(~F.col("acl").eqNullSafe(want))


def role_at_least(role, least: str):
    rank = F.when(F.lit(False), 0)
    for name, n in ROLES.items():
        rank = rank.when(role == name, n)
    return F.coalesce(rank, F.lit(0)) >= ROLES[least]
