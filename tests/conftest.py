import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vigilake import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def lines(spark):
    """Texts -> lines of one file, in order."""
    def make(*values, source_file="f.log"):
        rows = [(source_file, i, v) for i, v in enumerate(values)]
        return spark.createDataFrame(rows, "source_file string, seq bigint, value string")

    return make


@pytest.fixture
def findings():
    """Findings -> {rule name: row}."""
    return lambda df: {r.rule_name: r for r in df.collect()}
