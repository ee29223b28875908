import os
import sys

import pytest

# the library leaves memory to the submitter; local tests need more than the default
os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 8g pyspark-shell")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from churnforge.session import get_session
    s = get_session("local[*]", app="churnforge-tests", shuffle_partitions=8)
    yield s
    s.stop()
