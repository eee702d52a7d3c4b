"""One local session for all tests, with its scratch folder in a fresh place."""

from __future__ import annotations

import pytest

from docpress.session import build_session

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("docpress-tests", master="local[8]", streaming=True, extra={
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("scratch")),
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def sf_dir():
    return f"{TESTDATA}/sf0.001"


@pytest.fixture
def at(tmp_path):
    """Path factory: ``at("x")`` is a path below this test's own folder."""
    return lambda name: str(tmp_path / name)
