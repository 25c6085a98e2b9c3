import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from cutoffs.session import build_session

    s = build_session(os.environ.get("TEST_CPUS", "8"), shuffle_partitions=4, memory="6g", name="tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
