import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session(4, 4, app="ledgerlake-tests", driver_memory="4g")
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="ledgerlake-test-", dir="/tmp")
