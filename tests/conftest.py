"""One local session for all tests; the small tables of the driver as inputs."""

import pytest

from quillon.session import session

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "local[6]", 4, spark__ui__enabled="false", spark__driver__memory="4g", spark__driver__host="127.0.0.1")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def middle():
    return MIDDLE
