import pytest


@pytest.fixture(scope="session")
def make(spark):
    """A table from rows and a schema string, in several partitions."""

    def table(rows, schema, parts=3):
        return spark.createDataFrame(rows, schema).repartition(parts)

    return table
