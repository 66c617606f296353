import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tapemill.session import local_session

    return local_session(4, "4g")


@pytest.fixture(scope="session")
def sf():
    """The smallest tables; tests that need them are skipped elsewhere."""
    path = Path("/root/testdata/sf0.001")
    if not path.exists():
        pytest.skip("no test tables here")
    return str(path)
