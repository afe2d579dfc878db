import pytest

from flowlink.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("tests")
