import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    tmp = tmp_path_factory.mktemp("spark")
    s = SparkSession.builder.master("local[8]").config("spark.driver.memory", "4g").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.local.dir", str(tmp)).config("spark.sql.warehouse.dir", f"{tmp}/wh").config("spark.checkpoint.dir", f"file://{tmp}/cp").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
