import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from tickloom.session import session

    s = session("tickloom-tests", "local[4]", {"spark.sql.shuffle.partitions": "4"})
    yield s
    s.stop()
