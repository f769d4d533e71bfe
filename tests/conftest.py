import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from keyweave import build_session

    folder = tmp_path_factory.mktemp("checkpoints")
    session = build_session(
        "tests",
        master="local[8]",
        shuffle_partitions=4,
        extra={"spark.ui.enabled": "false", "spark.driver.memory": "6g"},
    )
    if session.conf.get("spark.checkpoint.dir", None) is None:
        session.sparkContext.setCheckpointDir(str(folder))
    yield session
    session.stop()
