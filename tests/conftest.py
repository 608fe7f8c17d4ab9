"""One small session for all tests."""

import pytest

from lumenframe.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
