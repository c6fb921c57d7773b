import pytest

import __spark_entry__ as entry
from tarn.plans import traffic, tweets
from tests.oracle import compare

QUERIES, SQL = {**traffic.QUERIES, **tweets.QUERIES}, {**traffic.SQL, **tweets.SQL}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    sf = "sf0.01" if name == "tweets_of_length" else "sf0.001"  # the smallest has no such text
    assert compare(spark, name, QUERIES[name], SQL[name], sf) > 0


def test_queries_without_sql_are_known(spark):
    assert set(QUERIES) == set(SQL)
    assert set(SQL) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
