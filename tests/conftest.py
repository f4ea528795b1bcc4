import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from polytag.session import build_session

    s = build_session("local[4]", shuffle_partitions=4, app="polytag-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def f1(spark):
    """Hand-worked fixture F1: 5 rows, 3 labels."""
    rows = [
        (1, [1, 0, 1], [0.9, 0.4, 0.5]),
        (2, [0, 0, 0], [0.2, 0.1, 0.1]),
        (3, [1, 1, 1], [0.3, 0.8, 0.8]),
        (4, [0, 1, 0], [0.6, 0.6, 0.1]),
        (5, [1, 0, 0], [0.5, 0.7, 0.2]),
    ]
    return spark.createDataFrame(rows, "id long, y array<int>, conf array<double>")
