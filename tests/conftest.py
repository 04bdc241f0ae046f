import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from pagefold.session import ensure_session_defaults
    s = (SparkSession.builder.master("local[4]").appName("pagefold-tests")
         .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.extraJavaOptions", "-Xss16m").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    ensure_session_defaults(s)
    yield s


def pages_df(spark, rows):
    """rows: list of (page_id, url, html)."""
    return spark.createDataFrame(rows, "page_id long, url string, html string")
