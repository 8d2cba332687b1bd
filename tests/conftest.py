import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from webtables.sources.session import local_session

    yield local_session()


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="webtables-test-")


@pytest.fixture
def one(spark):
    """Evaluate a column expression on a single literal row."""

    def evaluate(value, make, kind="string"):
        frame = spark.createDataFrame([(value,)], f"x {kind}")
        return frame.select(make(frame["x"]).alias("y")).first()["y"]

    return evaluate
