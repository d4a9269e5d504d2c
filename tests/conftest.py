import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from basketlens.session import build_session

    s = build_session("local[4]", shuffle_partitions=4, app_name="basketlens-tests")
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="basketlens-test-")


def orders_df(spark, rows):
    """Order log from literal rows ``(id_o, user_id, price, 'YYYY-MM-DD')``."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "id_o string, user_id string, price string, o_date string")
    return df.select(
        "id_o",
        "user_id",
        F.col("price").cast("decimal(12,2)").alias("price"),
        F.col("o_date").cast("date").alias("o_date"),
    )
