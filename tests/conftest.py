import pytest

from florilege.session import local_session
from tests.oracle import connection


@pytest.fixture(scope="session")
def spark():
    return local_session()


@pytest.fixture(scope="session")
def con():
    return connection()
