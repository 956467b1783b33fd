import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from data_dirs import SF01  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from quadrant.session import local_session
    s = local_session("*", shuffle_partitions=8)
    yield s


@pytest.fixture(scope="session")
def con01():
    from oracle_compare import duck
    return duck(SF01)
