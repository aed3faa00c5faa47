import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from corpusloom.session import session

    shared = tmp_path_factory.mktemp("shared")
    found = session("tests", 4, 4, **{"spark.driver.memory": "3g", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": str(shared), "spark.sql.warehouse.dir": str(shared / "warehouse")})
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()
