import os
import sys
import tempfile

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, REPO)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from cubewise.session import build_session, checkpoint_dir

    s = build_session("local[4]", app_name="cubewise-tests", shuffle_partitions=8,
                      conf={"spark.sql.maxMetadataStringLength": "2000"})
    checkpoint_dir(s, tempfile.mkdtemp(prefix="cubewise-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture
def scratch():
    return tempfile.mkdtemp(prefix="cubewise-test-")


def rows(df, *cols):
    """Rows of ``df`` as sorted tuples (of ``cols``, default all)."""
    cols = cols or tuple(df.columns)
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
