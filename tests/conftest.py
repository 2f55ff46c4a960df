import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

from logquarry.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, 4)


@pytest.fixture
def lines(spark):
    def make(texts, chunk=0):
        rows = [(chunk, i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "chunk_id long, line_no long, line string")

    return make
