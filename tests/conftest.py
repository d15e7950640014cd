import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from stationweave import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session.build("local[4]", "tests", spark__sql__shuffle__partitions="4")
    session.ship(s)
    yield s
    s.stop()
