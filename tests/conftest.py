from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from catalith.session import build_session, scratch_scope  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("scratch")))
    yield session
    session.stop()


@pytest.fixture
def shared(spark):
    """A scratch folder of the test's own; tells what lies in it."""
    with scratch_scope(spark, "test") as scope:
        yield lambda: sorted(os.listdir(scope.path.removeprefix("file:")))


@pytest.fixture(scope="session")
def small():
    return SMALL


def rows(df, *order):
    """All rows as plain dictionaries, in the given order."""
    return [row.asDict(recursive=True) for row in (df.orderBy(*order) if order else df).collect()]
