import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from insolvia.session import DRIVER_ROWS_KEY, TASK_ROWS_KEY, build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.sql.session.timeZone": "UTC"}
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture
def tiny_tasks(spark):
    """Pretend a task holds 40 rows, so the chunked routes run on small data."""
    spark.conf.set(TASK_ROWS_KEY, "40")
    yield spark
    spark.conf.unset(TASK_ROWS_KEY)


@pytest.fixture
def tiny_driver(spark):
    spark.conf.set(DRIVER_ROWS_KEY, "5")
    yield spark
    spark.conf.unset(DRIVER_ROWS_KEY)
