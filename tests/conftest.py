import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tradewind.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture
def evaluate(spark):
    """Apply a column function to literal texts and return the results in order."""

    def run(fn, values, kind="string"):
        from pyspark.sql import functions as F

        rows = [(i, v) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, f"i int, v {kind}")
        return [r.r for r in df.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()]

    return run
