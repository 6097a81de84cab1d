import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from skytally import session

    s = session.build("local[8]", "skytally-tests", 4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def views(spark):
    from skytally.plans.registry import Views

    return Views(spark, SF)
