"""The registered queries against their SQL on the smallest driver tables."""

import pytest

from checks.compare import connect, differences
from querytide.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(queries.oracles()))
def test_query_matches_its_sql(spark, duck, name):
    diff, _ = differences(queries.QUERIES[name](spark, SF), duck, queries.oracles()[name])
    assert diff is None, diff


def test_entry_point_lists_all():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert set(entry.oracle_sql()) <= names
