"""One Spark session for all tests."""

import pytest

from tidewater.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", 4, spark__ui__enabled="false", spark__driver__memory="4g", spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
