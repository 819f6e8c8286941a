import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), os.environ.get("PYTHONPATH", "")]))
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from docloom.session import build_session

    shared = tmp_path_factory.mktemp("shared")
    session = build_session(
        "tests", os.environ.get("TEST_MASTER", "local[4]"),
        **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": str(shared), "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(shared / "warehouse")},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def sf():
    return f"{DATA}/sf0.001"
