import os
from pathlib import Path

import pytest
from pyspark.sql import SparkSession


# Python workers import the library and the tests' own classes
HERE = Path(__file__).parent
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (str(HERE.parent), str(HERE), str(HERE / "llm"), os.environ.get("PYTHONPATH"))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
