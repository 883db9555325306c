import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from notelab.session import get_session
    session = get_session(master="local[4]", conf={"spark.sql.shuffle.partitions": "8"})
    yield session
    session.stop()


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]
