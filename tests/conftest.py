import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from compare import session

    s = session()
    if s.sparkContext.getCheckpointDir() is None:
        s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield s


@pytest.fixture()
def tiny_splits(spark):
    """Every group above three rows counts as too large for one task."""
    spark.conf.set("onsetry.splitRows", "3")
    yield spark
    spark.conf.unset("onsetry.splitRows")


@pytest.fixture(scope="session")
def duck():
    from compare import oracle

    return oracle(SF)
