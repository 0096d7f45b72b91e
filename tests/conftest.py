import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from vitalframe.session import build_session
    s = build_session(master="local[4]", shuffle_partitions=8,
                      extra={"spark.driver.memory": "6g"})
    yield s


@pytest.fixture(scope="session")
def sf_small():
    return SF_SMALL
