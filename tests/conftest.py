import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from codeloom.session import local_session

    return local_session("codeloom-tests", shuffle=4)


@pytest.fixture(autouse=True, scope="module")
def _released():
    """The work tables of a module's tests go with it."""
    yield
    from pyspark.sql import SparkSession

    from codeloom.session import release

    if (active := SparkSession.getActiveSession()) is not None:
        release(active)


@pytest.fixture(scope="session")
def tiny():
    return os.environ.get("CODELOOM_TEST_DATA", "/root/testdata/sf0.001")
