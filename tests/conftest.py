"""One local session for all tests; files are written to fresh temporary folders."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("lakeprofile-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture
def files_of(spark):
    """DataFrame of files with the columns the counters need."""

    def build(paths, encoding="utf-8", delimiter=","):
        rows = [(str(path), os.path.getsize(path), encoding, delimiter) for path in paths]
        return spark.createDataFrame(rows, "path string, size bigint, encoding string, delimiter string")

    return build
