import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from pipelytics.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows(spark):
    """Rows of a frame as tuples, sorted."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
