import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from millrace.session import session

    s = session("local[4]", 4, **{"spark.driver.memory": "4g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("OFF")
    s.sparkContext.setCheckpointDir(s.conf.get("spark.checkpoint.dir"))
    return s


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
