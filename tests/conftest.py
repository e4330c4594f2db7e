import os
import sys

import pytest
from pyspark import cloudpickle

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from turnstore.runtime import build_session  # noqa: E402


def pytest_collection_modifyitems(items):
    """Callers written in a test travel to the workers with the job."""
    for module in {item.module for item in items}:
        cloudpickle.register_pickle_by_value(module)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
            "spark.driver.bindAddress": "127.0.0.1", "spark.driver.host": "127.0.0.1"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
