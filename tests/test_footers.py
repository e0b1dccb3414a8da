"""Dates from footers: what is pushed down, and that answers are those of the rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortlift.sources import footers
from conftest import day, rows


@pytest.fixture(scope="module")
def made(spark):
    date = F.date_add(F.lit(dt.date(2020, 1, 1)), (F.col("id") % 5).cast("int"))
    return spark.range(40).select("id", F.when(F.col("id") % 8 != 3, date).alias("signup_date"))


@pytest.mark.parametrize("parts", [[], ["signup_date"]])
def test_answers_are_those_of_the_rows(spark, made, parts, tmp_path):
    path = str(tmp_path / "t")
    made.repartition(3).write.partitionBy(*parts).parquet(path)
    assert footers.latest_stored_date(spark, path).collect() == [(day("2020-01-05"),)]
    assert rows(footers.stored_dates(spark, path)) == rows(
        made.groupBy("signup_date").agg(F.count("*").alias("rows")))


def explained(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_no_rows_are_read(spark, made, tmp_path):
    flat, divided = str(tmp_path / "flat"), str(tmp_path / "divided")
    made.write.parquet(flat)
    made.write.partitionBy("signup_date").parquet(divided)
    assert "PushedAggregation: [MAX(signup_date)]" in explained(footers.latest_stored_date(spark, flat))
    for df in (footers.latest_stored_date(spark, divided), footers.stored_dates(spark, divided)):
        assert "PushedGroupBy: [signup_date]" in explained(df)
    # The caller's session is as it was.
    assert "PushedAggregation" not in explained(spark.read.parquet(flat).agg(F.max("signup_date")))


def test_nothing_stored(spark, made, tmp_path):
    made.filter("false").write.parquet(str(tmp_path / "t"))
    assert footers.latest_stored_date(spark, str(tmp_path / "t")).collect() == [(None,)]
    assert footers.stored_dates(spark, str(tmp_path / "t")).collect() == []
