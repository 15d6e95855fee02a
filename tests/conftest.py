import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quarryline.session import build_session

    s = build_session("tests", cores=8, **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": "file://" + tempfile.mkdtemp(prefix="quarryline-test-")})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
