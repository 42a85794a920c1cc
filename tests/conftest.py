import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from scrubline.session import local_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Build a one-column text frame, or any frame from rows and a schema."""

    def build(values, schema="v string"):
        rows = [v if isinstance(v, tuple) else (v,) for v in values]
        return spark.createDataFrame(rows, schema)

    return build


@pytest.fixture
def run(frame):
    """Values of a column expression over a list of inputs, in input order."""
    from pyspark.sql import functions as F

    def apply(expression, values):
        numbered = [(i, v) for i, v in enumerate(values)]
        df = frame(numbered, "i int, v string").select("i", expression(F.col("v")).alias("r"))
        return [r["r"] for r in sorted(df.collect(), key=lambda r: r["i"])]

    return apply
