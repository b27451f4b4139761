import __spark_entry__ as entry
from verbatrix.queries import QUERIES, SQL


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "id", "rerank_rank", "rerank_score"] and df.count() > 0
