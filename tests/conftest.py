import os
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
# Python workers find the package the same way.
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])

import pytest  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from panelkite.session import local_session

    session = local_session(cores=int(os.environ.get("TEST_CPUS", "4")), shuffles=4, memory="4g")
    yield session
    session.stop()
