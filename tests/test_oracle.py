import pytest
from oracle import same, views

from markwise.plans import data_queries, exam_queries, review_queries, rule_queries

SQL = exam_queries.oracle_sql() | data_queries.oracle_sql() | review_queries.oracle_sql() | rule_queries.oracle_sql()
QUERIES = exam_queries.queries() | data_queries.queries() | review_queries.queries() | rule_queries.queries()


@pytest.fixture(scope="module")
def duck(data):
    return views(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, data, duck, name):
    same(QUERIES[name](spark, data), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, data, name):
    frame = QUERIES[name](spark, data)
    assert frame.count() > 0 and len(set(frame.columns)) == len(frame.columns)


def test_entry_lists_the_core_queries():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
