import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from folioforge.session import local_session, ship_package

    s = local_session("4", "tests", **{"spark.sql.shuffle.partitions": "4"})
    ship_package(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
