"""All queries of the engine itself."""

from palimpsest.plans import audit_queries, corpus_queries, evaluation_queries, policy_queries, retrieval_queries, serving_queries  # noqa: F401
from palimpsest.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
