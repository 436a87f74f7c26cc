import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tradewind.session import local_session
    s = local_session(cores="*", shuffle_partitions=8, app="tradewind-tests")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tradewind-tests-"))
    yield s


@pytest.fixture(scope="session")
def sf_small():
    return SF_SMALL
