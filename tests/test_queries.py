import pytest

from corpusmith.plans import files, logs, preparation, programs, rewrites, smoothing  # noqa: F401
from corpusmith.plans.relational import ORACLES, QUERIES
from tests.oracle import DATA, assert_same, connect

SF = "sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, con, name):
    assert_same(QUERIES[name](spark, f"{DATA}/{SF}"), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, f"{DATA}/{SF}").count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
