import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))

from narrprep.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture
def one(spark):
    """Value of a Column function for one text."""
    from pyspark.sql import functions as F

    def run(fn, value, type_="string"):
        return spark.createDataFrame([(value,)], f"c {type_}").select(fn(F.col("c"))).first()[0]

    return run
