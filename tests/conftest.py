import datetime as dt
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(text):
    return None if text is None else dt.date.fromisoformat(text)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df, columns=None):
    """Rows as a sorted list of tuples."""
    columns = columns or sorted(df.columns)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()),
                  key=lambda r: tuple((v is None, str(v)) for v in r))
