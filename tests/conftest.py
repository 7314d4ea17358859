import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from regframe.session import checkpoint_dir, get_session
    s = get_session("local[4]", shuffle_partitions=4, extra={"spark.driver.memory": "4g"})
    checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def f3(spark):
    """FIXTURES.md F3: groups a a b b c c; x 0..5; m 1 0 2 1 3 2; y 1 3 2 5 4 8."""
    rows = [("a", 0.0, 1.0, 1.0), ("a", 1.0, 0.0, 3.0), ("b", 2.0, 2.0, 2.0),
            ("b", 3.0, 1.0, 5.0), ("c", 4.0, 3.0, 4.0), ("c", 5.0, 2.0, 8.0)]
    return spark.createDataFrame(rows, "g string, x double, m double, y double").repartition(3)
