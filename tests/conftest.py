import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from barloom import build_session

    s = build_session("tests", "8", 8)
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield s
    s.stop()


@pytest.fixture
def split_groups(spark):
    """Force the chunked layout by lowering the group limit."""

    def lower(rows):
        spark.conf.set("barloom.maxGroupRows", str(rows))

    yield lower
    spark.conf.unset("barloom.maxGroupRows")
