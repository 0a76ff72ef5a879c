import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from hushframe.sources.rows import with_row_number  # noqa: E402
from hushframe.workspace import Workspace  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def ws(spark):
    return Workspace(spark)


@pytest.fixture(scope="session")
def table(spark, ws):
    """Rows to a numbered text table."""

    def make(columns, rows):
        df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns)).coalesce(1)
        return with_row_number(df, ws)

    return make


def ordered(df):
    return [tuple(r) for r in df.orderBy("_row").drop("_row").collect()]


def books(keymap):
    """A key map's codebook as nested dictionaries."""
    out = {}
    for r in keymap.book.collect():
        out.setdefault(r.sheet, {}).setdefault(r.field, {})[r.label] = r.code
    return out
