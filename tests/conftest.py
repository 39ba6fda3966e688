import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from riskweir.session import build_session

    session = build_session("tests", "local[4]", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session


@pytest.fixture(scope="session")
def parts(spark):
    from riskweir.sources import testbed

    return testbed.split_merchants(spark, SF).persist()


@pytest.fixture(scope="session")
def scored(spark):
    from riskweir.sources import testbed

    return testbed.stored(testbed.scored_long(spark, SF), "scored-long")
