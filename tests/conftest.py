import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from paths import SF_SMALL  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from ledgerline.session import build_session

    s = build_session("local[4]", shuffle_partitions=8, app_name="ledgerline-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small(spark):
    from ledgerline.sources.tables import Tables

    return Tables(spark, SF_SMALL)


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="ledgerline-test-")
