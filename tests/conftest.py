import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from opinara.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[8]",
        shuffle_partitions=4,
        **{
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture
def c(spark):
    from pyspark.sql import functions as F

    return F.col("c")


@pytest.fixture
def one(spark):
    """Evaluates a column over one row of named values."""

    def evaluate(column, **values):
        from pyspark.sql import types as T

        kinds = {str: T.StringType(), int: T.IntegerType(), float: T.DoubleType(), type(None): T.StringType()}
        schema = T.StructType([T.StructField(n, kinds[type(v)]) for n, v in values.items()])
        return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]

    return evaluate
