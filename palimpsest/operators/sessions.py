"""Conversations as ordered turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, rendered): role and text of each turn that isn't blank, in order."""
    rows = turns.where(F.trim("text") != "").groupBy("conv_id")
    line = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.concat(t["role"], F.lit(": "), F.trim(t["text"])))
    return rows.agg(F.count("*").alias("turns"), F.array_join(line, "\n").alias("rendered"))


def session_slug(question, session):
    return F.concat(F.lit("lme-"), F.substring(F.sha2(F.concat(question, F.lit("\u0000"), session), 256), 1, 20))


def distinct_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions (session_id, body) once each; an id with two bodies is marked as in conflict."""
    return sessions.groupBy("session_id").agg(F.min("body").alias("body"), (F.count_distinct(F.sha2("body", 256)) > 1).alias("conflict"))
