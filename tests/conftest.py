import pytest

from tessera.session import build_session


@pytest.fixture(scope="session")
def spark():
    return build_session("local[4]", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})


@pytest.fixture
def frame(spark):
    """Rows of a small table by DDL."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
