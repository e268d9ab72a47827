import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from priorline.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture
def hot(spark):
    """Force the hot-key plan for every key with more than 40 rows."""
    from priorline.skew import HOT_ROWS_SETTING

    spark.conf.set(HOT_ROWS_SETTING, "40")
    yield
    spark.conf.unset(HOT_ROWS_SETTING)
