import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

DATA = os.path.join(ROOT, "tests", "data")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from washline.session import get_session
    s = get_session("local[4]", shuffle_partitions=4)
    yield s


@pytest.fixture(scope="session")
def states(spark):
    from washline.sources.roads import read_states
    return read_states(spark, {s: os.path.join(DATA, f"{s}.csv") for s in ("NH", "RI", "TX")})
