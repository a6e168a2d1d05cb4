import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from millrace.session import session

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    made = session(
        "local[2]", 4,
        **{"spark.ui.enabled": "false", "spark.local.dir": folder, "spark.sql.warehouse.dir": f"{folder}/warehouse", "spark.driver.memory": "3g", "spark.default.parallelism": "2"},
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
