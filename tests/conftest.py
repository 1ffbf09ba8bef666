import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from revspark.session import build_session
    s = build_session(master="local[*]", shuffle_partitions=8, app_name="revspark-tests")
    if not s.conf.get("spark.checkpoint.dir", None):      # tests only: a scratch checkpoint folder
        d = tempfile.mkdtemp(prefix="revspark-test-ckpt-")
        s.conf.set("spark.checkpoint.dir", d)
        s.sparkContext.setCheckpointDir(d)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_small():
    return "/root/testdata/sf0.001"
