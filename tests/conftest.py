import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from jobloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("jobloom-tests", cpus=4, shuffle_partitions=4, memory="6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def column(spark):
    """Evaluate a one-column expression on a list of rows."""
    def evaluate(schema, rows, expression):
        df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
        return [r[0] for r in df.coalesce(1).select(expression).collect()]
    return evaluate
