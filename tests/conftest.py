import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from veilspan.session import session, ship

    own = session("local[4]", 4, spark_driver_memory="4g", spark_ui_showConsoleProgress="false", spark_sql_warehouse_dir=tempfile.mkdtemp())
    own.sparkContext.setLogLevel("ERROR")
    return ship(own)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
