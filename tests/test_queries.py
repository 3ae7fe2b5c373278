import pytest

import __spark_entry__ as entry
from palimpsest.plans.queries import ORACLE_SQL, QUERIES
from tests.helpers import same

#: Thin data at the smallest factor leaves these without rows.
MAY_BE_EMPTY = {"link_cap", "mention_links", "near_dup_consolidate", "kw_and_tier"}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_its_sql(spark, duck, sf, name):
    n = same(QUERIES[name](spark, sf), duck.execute(ORACLE_SQL[name]))
    assert n or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_others_have_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["qid", "chunk_id", "page_id", "score", "rank"]
    assert df.count() > 0


def test_sql_only_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
