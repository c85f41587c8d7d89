import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from riskspark.session import get_spark  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", "8")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture()
def scripts(spark):
    """scripts("text", ...) -> frame (id, script)"""
    def make(*texts):
        return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, script string")
    return make
