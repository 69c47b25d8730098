import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from rankmart.session import get_spark, checkpoint_dir

    s = get_spark("local[4]", 4, app_name="rankmart-tests",
                  extra={"spark.sql.shuffle.partitions": "4"})
    checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="rankmart-test-")
