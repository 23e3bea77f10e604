import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from stoagraph.session import local_session

    return local_session("4", 4)


@pytest.fixture(scope="session")
def sf():
    """The smallest test data, where it is present."""
    d = "/root/testdata/sf0.001"
    if not Path(d).exists():
        pytest.skip("no test data")
    return d
