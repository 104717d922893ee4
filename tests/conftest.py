import os

import pytest

from tests.session import make_session


@pytest.fixture(scope="session")
def spark():
    return make_session(os.environ.get("TEST_CPUS", "8"))


@pytest.fixture(scope="session")
def data_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
