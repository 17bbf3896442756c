import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from keystrata.session import drop_checkpoints, get_session

    session = get_session("local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g", "spark.python.sql.dataFrameDebugging.enabled": "false",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_checkpoints(session)
    session.stop()
