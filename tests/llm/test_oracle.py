import pytest

from grainflow.llm import queries as llm
from tests.llm.helpers import SF
from tests.oracle import assert_same, connect


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_matches_sql(spark, name):
    assert_same(llm.QUERIES[name](spark, SF), connect(SF).sql(llm.SQL[name]))


def test_all_are_registered():
    import __spark_entry__ as e

    assert set(llm.QUERIES) | {"pipeline"} <= set(e.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in llm.QUERIES) == list(range(1, 14))
