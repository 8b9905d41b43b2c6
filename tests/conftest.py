import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfspark.session import get_spark  # noqa: E402

SMOKE_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[*]", 8, app_name="shelfspark-tests")
    yield s
    s.stop()


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]
