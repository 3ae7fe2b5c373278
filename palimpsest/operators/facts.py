"""Typed facts: parsing of stored model responses, and consolidation by cosine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import kebab
from palimpsest.operators.nearest import nearest_earlier

#: Fixed values.
KINDS = ("claim", "event", "metric", "preference", "relationship")
MOST = 10
FACT = "struct<facts:array<struct<claim:string,kind:string,entity:string,metric:string,value:double,unit:string,period:string,confidence:double,event_type:string,valid_from:string>>>"


def unfenced(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(raw), "^```[a-zA-Z]*\\s*", ""), "\\s*```$", "")


def parse_facts(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds facts and parse_failed: at most ten, a bad one dropped alone, kinds and confidence put in bounds."""
    parsed = F.from_json(unfenced(F.col(raw)), FACT)
    tidy = lambda f: F.struct(
        F.trim(f["claim"]).alias("claim"),
        F.when(f["kind"].isin(*KINDS), f["kind"]).otherwise("claim").alias("kind"),
        F.nullif(F.substring(kebab(f["entity"]), 1, 200), F.lit("")).alias("entity"),
        f["metric"].alias("metric"), f["value"].alias("value"), f["unit"].alias("unit"), f["period"].alias("period"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(f["confidence"], F.lit(0.5)))).alias("confidence"),
        F.when(f["kind"] == "event", f["event_type"]).alias("event_type"),
        F.try_to_date(f["valid_from"]).alias("valid_from"),
    )
    good = F.filter(parsed["facts"], lambda f: f["claim"].isNotNull() & (F.trim(f["claim"]) != ""))
    facts = F.slice(F.transform(good, tidy), 1, MOST)
    return rows.withColumn("parse_failed", parsed["facts"].isNull()).withColumn("facts", F.coalesce(facts, F.array().cast(facts_type())))


def facts_type() -> str:
    return "array<struct<claim:string,kind:string,entity:string,metric:string,value:double,unit:string,period:string,confidence:double,event_type:string,valid_from:date>>"


def consolidate(facts: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(fact_id, into_id, cos): each fact's nearest earlier fact of its entity, if near enough (``nearest`` says what null and zero vectors do)."""
    best = nearest_earlier(facts, threshold, "entity", "fact_id", "vec")
    return best.select(F.col("id").alias("fact_id"), "into_id", F.round("cos", 6).alias("cos"))
