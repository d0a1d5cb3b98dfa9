import pytest

from checks.session import session


@pytest.fixture(scope="session")
def spark():
    return session("8", partitions=4)
