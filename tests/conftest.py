import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tallyspark.session import get_spark
    s = get_spark("local[8]", 8, app="tallyspark-tests")
    yield s


SF_SMALL = "/root/testdata/sf0.001"
