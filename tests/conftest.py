from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from hoplens.session import build_session, checkpoint_dir  # noqa: E402
from hoplens.sources.ledger import CLEAN_LEDGER_SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[*]", app_name="hoplens-tests", shuffle_partitions=8,
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="hoplens-tests-")})
    checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture
def ledger_of(spark):
    """Build a clean ledger from (timestamp, from, to, value) tuples."""
    def make(rows):
        return spark.createDataFrame(rows, CLEAN_LEDGER_SCHEMA)
    return make


@pytest.fixture
def ids_of(spark):
    def make(ids, column="id"):
        return spark.createDataFrame([(i,) for i in ids], f"{column} string")
    return make
