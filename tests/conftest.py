import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from codesieve.session import get_spark
    s = get_spark("codesieve-tests", master="local[8]", shuffle_partitions=8)
    yield s
    s.stop()
