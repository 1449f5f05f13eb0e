"""Fixture of the tests in this folder."""

import pytest


@pytest.fixture
def frame(spark):
    """A DataFrame from literal rows, dealt over a few partitions."""
    def make(rows, schema):
        return spark.createDataFrame(rows, schema).repartition(3)
    return make
