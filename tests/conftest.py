import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from custlens.session import get_session
    s = get_session("local[4]", app="custlens-tests", shuffle_partitions=4,
                    extra={"spark.driver.memory": "4g",
                           "spark.checkpoint.dir": tempfile.mkdtemp(prefix="custlens-test-ckpt-")})
    yield s
    s.stop()
