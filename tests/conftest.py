import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from tableloom.session import local_frame, local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", cores="8", partitions=4)


@pytest.fixture(scope="session")
def frame(spark):
    """``frame(rows, schema)`` as a small DataFrame."""
    return lambda rows, schema: local_frame(spark, rows, schema)
