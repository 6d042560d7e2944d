import pytest

from tests.conftest import SMALL


@pytest.fixture(scope="session")
def small():
    return SMALL
