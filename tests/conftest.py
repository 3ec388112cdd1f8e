import os

import pytest

from retailscope.session import local_session
from retailscope.sources.standin import Star

SMALL = os.environ.get("RETAILSCOPE_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shared"))
    session = local_session("tests", 8, **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": folder})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def star(spark):
    return Star(spark, SMALL)


def rows(df, *order):
    """Rows as plain tuples, sorted when an order is given."""
    found = [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
    return found


@pytest.fixture
def listed():
    return rows
