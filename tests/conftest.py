import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.path.join(os.path.dirname(os.path.abspath(__file__)), "data")
SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from telemetra.session import build_session
    ck = tempfile.mkdtemp(prefix="telemetra-test-ck-")
    s = build_session(master="local[4]", shuffle_partitions=8, extra={"spark.checkpoint.dir": ck})
    yield s
    s.stop()


@pytest.fixture()
def tmp_out(tmp_path):
    return str(tmp_path)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)
