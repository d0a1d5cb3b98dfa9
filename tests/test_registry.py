"""Every registered query against its SQL on the smallest driver tables."""

import pytest

from checks.compare import connect, differences
from checks.registry import all_checks
from checks.sqlkit import statement

SF = "/root/testdata/sf0.001"
CHECKS = all_checks()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(CHECKS))
def test_query_matches_its_sql(spark, duck, name):
    query, final = CHECKS[name]
    diff, _ = differences(query(spark, SF), duck, statement(final))
    assert diff is None, diff
