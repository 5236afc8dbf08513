import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Small tables by rows and a DDL schema, over several partitions."""
    return lambda rows, schema, parts=3: spark.createDataFrame(rows, schema).repartition(parts)
