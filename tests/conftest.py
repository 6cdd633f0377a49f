import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quizlake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", shuffle_partitions=8, memory="8g")
    yield session
    session.stop()


@pytest.fixture
def rows_of():
    """The rows of a frame as sorted tuples."""

    def collect(frame, *columns):
        picked = frame.select(*columns) if columns else frame
        return sorted((tuple(row) for row in picked.collect()), key=repr)

    return collect


@pytest.fixture
def sql_settings(spark):
    """Set SQL settings for one test and put the old values back."""
    saved = {}

    def change(**settings):
        for key, value in settings.items():
            name = key.replace("__", ".")
            saved.setdefault(name, spark.conf.get(name, None))
            spark.conf.set(name, value)

    yield change
    for name, value in saved.items():
        if value is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, value)
