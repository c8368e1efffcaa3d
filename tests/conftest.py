import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rowferry.session import local_session, scratch_path  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "rowferry-tests")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.maxMetadataStringLength", 100_000)
    yield session
    session.stop()


@pytest.fixture
def out(spark):
    return scratch_path(spark, "test")


@pytest.fixture(scope="session")
def sf():
    return SF
