import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from gleaner.session import checkpoint_dir, local_session

    s = local_session(cores="*", shuffle_partitions=8, app="gleaner-tests")
    checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def pages(spark):
    from fixtures import pages_df

    from gleaner.sources.pages import read_pages_from

    return read_pages_from(pages_df(spark))
