import pytest

from traceloom.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    import os

    os.environ.setdefault("TZ", "UTC")
    return local_session(4, 4, "4g", "tests")


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF
