import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from siftline.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", "tests", **{"spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def small_blocks(spark):
    """Files split into blocks of some hundred bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.fixture
def records(spark):
    """Records out of plain texts, one per line of a file called ``f.txt``."""
    from pyspark.sql import functions as F

    def build(*texts):
        rows = [(text, "", number, "f.txt", "f.txt", "$") for number, text in enumerate(texts, 1)]
        return spark.createDataFrame(
            rows, "content string, record_id string, line bigint, file string, source_file string, target string"
        ).withColumn("line", F.col("line"))

    return build
