import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    import tempfile
    from loanlens.session import build_session
    # managed tables (the bucketed layout) go to a scratch warehouse
    s = build_session(master="local[*]", shuffle_partitions=8, app_name="loanlens-tests",
                      extra={"spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="loanlens-wh-")})
    yield s
    s.stop()


def rows(df, *cols):
    """Collect a small test result as a list of tuples (tests only)."""
    cols = cols or tuple(df.columns)
    return [tuple(r[c] for c in cols) for r in df.collect()]
