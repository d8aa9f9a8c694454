import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from ravel.session import local_session

    s = local_session(cpus="*", partitions=8, app="ravel-tests")
    yield s
    s.stop()


def one(spark, expr, **cols):
    """Evaluate a Column expression over one row of string/any literals."""
    from pyspark.sql import functions as F

    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return df.select(expr.alias("out")).first()["out"]
