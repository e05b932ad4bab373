from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from demandlens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("demandlens-tests", master="local[4]")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
