import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from ultradia.session import local_session

    s = local_session(4, partitions=4, memory="4g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
