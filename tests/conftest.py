import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from quantloom.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def split_mode(spark):
    """Force the distributed forms that are used when a date may be too large for one task."""
    spark.conf.set("quantloom.window.maxGroupRows", "0")
    yield
    spark.conf.unset("quantloom.window.maxGroupRows")
