import os
import sys
from datetime import timedelta

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

from helpers import START  # noqa: E402

from gridloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", 8, quiet=True)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def grid_of(spark):
    """Grid rows of one series from a list of values; None is a gap."""

    def make(values, station="A", variable="v", split="train"):
        rows = [
            (station, variable, START + timedelta(minutes=15 * i), None if v is None else float(v), i, len(values), split)
            for i, v in enumerate(values)
        ]
        schema = "station string, variable string, ts timestamp_ntz, value double, pos bigint, n_pos bigint, split string"
        return spark.createDataFrame(rows, schema)

    return make
