import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from ferrolith.session import build_session

    base = tmp_path_factory.mktemp("spark")
    conf = {"spark.checkpoint.dir": f"file://{base}/shared", "spark.sql.warehouse.dir": f"{base}/warehouse", "spark.local.dir": f"{base}/local", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"}
    session = build_session("tests", "local[4]", 4, **conf)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
