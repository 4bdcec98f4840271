import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from codeloom.session import get_session  # noqa: E402

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", 4)
    yield s


def files_df(spark, rows, binary=False):
    """rows: (relative, content) -> file table."""
    from pyspark.sql import functions as F
    schema = "relative string, content " + ("binary" if binary else "string")
    df = spark.createDataFrame(rows, schema)
    size = F.octet_length("content") if not binary else F.length("content")
    return df.select(F.concat(F.lit("/root/"), "relative").alias("path"), "relative",
                     size.cast("bigint").alias("size"),
                     F.timestamp_seconds(F.lit(1700000000)).alias("mtime"), "content")
