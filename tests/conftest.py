import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from check import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("4")
    yield s
    s.stop()


@pytest.fixture
def values(spark):
    """Apply a Column function to a list of values and return the results in order."""
    from pyspark.sql import functions as F

    def run(fn, data, kind="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, v {kind}")
        return [r[0] for r in df.select(fn(F.col("v")).alias("r"), "i").orderBy("i").select("r").collect()]
    return run
