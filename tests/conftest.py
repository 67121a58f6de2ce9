import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from granary.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4, app="tests")
    yield session
    session.stop()


@pytest.fixture
def tiny_groups(spark):
    """Every group counts as too large for one task, which forces the ranged routes."""
    spark.conf.set("granary.groupLimit", "7")
    yield
    spark.conf.unset("granary.groupLimit")
