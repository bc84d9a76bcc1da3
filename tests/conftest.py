import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from millrace.session import local_session

    s = local_session(4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.sql.streaming.stateStore.maintenanceInterval": "600s"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    d = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not Path(d).exists():
        pytest.skip(f"{d} is not there")
    return d
