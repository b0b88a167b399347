import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests"), os.path.dirname(os.path.abspath(__file__))]

from llm_cases import AWKWARD  # noqa: E402

@pytest.fixture(scope="session")
def spark():
    from flowsight.session import build_session
    s = build_session("local[4]", shuffle_partitions=4, app="llm-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def awkward(spark):
    """Awkward rows with extra columns whose names clash with the operators' own."""
    rows = [(i, t, s, -1, "k", 0.5) for i, t, s in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, key string, n_tokens double")


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)
