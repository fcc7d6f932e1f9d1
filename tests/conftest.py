import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from gridspan.session import local_session, ship

    s = local_session(os.environ.get("TEST_CPUS", "4"))
    s.sparkContext.setLogLevel("ERROR")
    return ship(s)
