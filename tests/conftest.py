from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from panelscope.session import local_session, use_local_scratch  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    use_local_scratch(str(tmp_path_factory.mktemp("scratch")))
    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.01"
