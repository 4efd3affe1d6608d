import pytest

from grainflow.plans import queries as core
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_matches_sql(spark, con, name):
    assert_same(core.QUERIES[name](spark, SF), con.sql(core.SQL[name]))


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_runs(spark, name):
    assert core.QUERIES[name](spark, SF).count() > 0


def test_entry_works_alone(spark):
    import __spark_entry__ as e

    assert {r["method"] for r in e.entry(spark).collect()} == {"voigt", "reuss", "hill"}
    assert set(core.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
