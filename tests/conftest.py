import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return session()


@pytest.fixture(scope="session")
def people(spark):
    return spark.createDataFrame(
        [("Alice", 25, 50000, 30000), ("Bob", 30, 60000, 40000), ("Charlie", 35, 70000, 50000), ("David", 40, 80000, 60000)],
        "name string, age long, income long, expenses long",
    )


@pytest.fixture(scope="session")
def gaps(spark):
    """Missing values, ties, a negative and a constant."""
    return spark.createDataFrame(
        [(1, "b", 1.0, 5.0), (2, "a", None, 5.0), (3, None, 3.0, 5.0), (4, "b", -2.0, 5.0), (5, "a", 3.0, 5.0), (6, "c", 10.0, 5.0)],
        "id int, g string, x double, k double",
    )
