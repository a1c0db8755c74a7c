import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

DATA = os.environ.get("LARDER_TESTDATA", "/root/testdata")
SMALL = f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from larder.session import local_session
    session = local_session(4, "larder-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def features(spark):
    """Feature table of the small data, stored once."""
    from registry.common import feature_table
    return feature_table(spark, SMALL)


def series(spark, values, series_id="a", start="2024-01-01", column="demand_model"):
    """A daily table of one column, one row per value."""
    import datetime as dt
    first = dt.date.fromisoformat(start)
    rows = [(series_id, first + dt.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"series_id string, date date, {column} double")
