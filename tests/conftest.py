import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from checks.compare import duck, session  # noqa: E402
from gradus.storage import release  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return session(cores="*")


@pytest.fixture(autouse=True)
def nothing_left_behind(request):
    """Intermediate tables of a test go with it."""
    yield
    if "spark" in request.fixturenames:
        release(request.getfixturevalue("spark"))


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF_DIR):
        pytest.skip(f"{SF_DIR} is not there")
    return SF_DIR


@pytest.fixture(scope="session")
def database(sf_dir):
    return duck(sf_dir)
