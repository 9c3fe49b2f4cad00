import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from wirelake.session import local_session
    os.environ.setdefault("WIRELAKE_PARTITIONS", "4")
    s = local_session("4", "tests")
    yield s
    s.stop()
