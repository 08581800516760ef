from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from lakestar.session import get_session

    shared = tempfile.mkdtemp(prefix="lakestar-test-")
    session = get_session(
        "local[*]",
        app_name="lakestar-tests",
        shuffle_partitions=8,
        # Tests set their own shared folder (unset otherwise); clusters name theirs.
        conf={"spark.checkpoint.dir": shared},
    )
    yield session
    session.stop()


@pytest.fixture
def tmp_dir(spark):
    from lakestar.session import fresh_workspace

    return fresh_workspace(spark, "test")
