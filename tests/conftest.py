import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from parcelsight.session import local_session

    return local_session("tests", cores=4)


@pytest.fixture(scope="session")
def sf_dir():
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test tables on this machine")
    return path


@pytest.fixture()
def rows(spark):
    """Small tables from tuples and a schema string."""
    return lambda data, schema: spark.createDataFrame(data, schema)
