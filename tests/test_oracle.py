import pytest

from framewright.plans.queries import QUERIES

from .oracle import both, connect


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_matches_sql(spark, data, con, name):
    f, sql = QUERIES[name]
    ours, theirs = both(f(spark, data), con, sql)
    assert ours == theirs


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if not sql])
def test_runs(spark, data, name):
    assert QUERIES[name][0](spark, data).count() > 0
