import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tools.check import session
    s = session("8")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def con():
    from tools.check import duck
    return duck(SF)


@pytest.fixture(scope="session")
def tables(spark):
    from tessera.plans.views import Tables
    return Tables(spark, SF)
