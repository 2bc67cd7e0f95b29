import pytest

from tidemark.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", 4, {"spark.ui.enabled": "false", "spark.driver.memory": "6g"})
    session.sparkContext.setLogLevel("ERROR")
    return session
