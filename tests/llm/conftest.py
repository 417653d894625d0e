import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) pairs, with columns whose names operators use inside."""
    def make(rows):
        return spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, _row string, score long")

    return make
