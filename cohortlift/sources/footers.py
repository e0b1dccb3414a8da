"""Dates of stored tables, read from file footers instead of rows.

Parquet keeps the least and greatest value of a column, and the number of
rows, in every file. Spark's second kind of file source can answer from these
alone; it is switched on in a session of its own, so that nothing else of the
caller's plans changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _footer_session(spark: SparkSession) -> SparkSession:
    session = spark.newSession()
    first_kind = spark.conf.get("spark.sql.sources.useV1SourceList").split(",")
    session.conf.set("spark.sql.sources.useV1SourceList", ",".join(k for k in first_kind if k.strip() != "parquet"))
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(name, spark.conf.get(name))
    return session


def _is_partition(session: SparkSession, path: str, column: str) -> bool:
    """Whether the folder is divided by ``column``: then no file holds it."""
    rows = session.read.parquet(path).groupBy(column).count()
    return "PushedGroupBy: [" in rows._jdf.queryExecution().explainString(
        session._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def stored_dates(spark: SparkSession, path: str, column: str = "signup_date") -> DataFrame:
    """Every date of a Parquet folder with its number of ``rows``.

    Where the folder is divided by the date, footers and folder names answer;
    else the column is read and counted. Rows without a date count as one, null.
    An empty folder gives no rows.
    """
    return _footer_session(spark).read.parquet(path).groupBy(column).agg(F.count("*").alias("rows"))


def latest_stored_date(spark: SparkSession, path: str, column: str = "signup_date") -> DataFrame:
    """One row: the newest date of a Parquet folder, null if there is none.

    A column of the files comes from their footers, a date that the folder is
    divided by from the folder's names. Dates and numbers have exact footers;
    of other types the column is read.
    """
    session = _footer_session(spark)
    rows = session.read.parquet(path)
    if not _is_partition(session, path, column):
        return rows.agg(F.max(column).alias(column))
    # A count that nothing reads would be taken out, and the footers with it.
    dates = rows.groupBy(column).agg(F.count("*").alias("rows"))
    return dates.agg(F.max(F.when(F.col("rows") > 0, F.col(column))).alias(column))
