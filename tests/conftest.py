import os
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, os.environ.get("PYTHONPATH", "")) if p)

import pytest  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from rollcall.session import local_session

    session = local_session(4, "3g", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
