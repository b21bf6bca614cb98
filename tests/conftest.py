import pytest

from tests.harness import session


@pytest.fixture(scope="session")
def spark():
    return session("tests")
