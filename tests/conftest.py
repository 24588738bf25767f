import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from plumbline.session import get_spark
    s = get_spark("tests", master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="plumbline-tests-")})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
