import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from threadloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "tests", spark__sql__shuffle__partitions="4")
    yield s
    s.stop()
