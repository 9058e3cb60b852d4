import pytest

from matchloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(cores="4", memory="8g", app="matchloom-tests")
