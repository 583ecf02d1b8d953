import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

from gamspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("gamspark-tests", cpus=8, partitions=8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("GAMSPARK_TEST_SF", "/root/testdata/sf0.001")
