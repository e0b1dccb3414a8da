"""Bucketed feature tables: same rows, no shuffle under the joins."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from cohortlift.plans import frames
from cohortlift.sources import bucketed
from cohortlift.sources.fixtures import Fixtures
from conftest import SMALL, plan_of, rows
from registry import queries as registered


@pytest.fixture
def name(spark):
    table = f"features_{uuid.uuid4().hex}"
    yield table
    spark.sql(f"DROP TABLE IF EXISTS {table}")


@pytest.fixture
def made(spark):
    return spark.createDataFrame(
        [(1, "2020-01-01", 5), (2, "2020-01-01", None), (None, "2020-01-02", 7), (1, None, 8), (1, "2020-01-01", 5)],
        "hs_user_id long, signup_date string, plays long").withColumn("signup_date", F.col("signup_date").cast("date"))


def test_rows_stay_as_they_are(spark, made, name, tmp_path):
    bucketed.write_bucketed(made, name, 4, path=str(tmp_path / "t"))
    assert rows(spark.table(name)) == rows(made)
    assert bucketed.bucketing(spark, name) == (4, ["hs_user_id", "signup_date"])


def test_a_bucket_is_one_file_a_call(spark, name, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("hs_user_id"), F.current_date().alias("signup_date"))
    bucketed.write_bucketed(df.repartition(7), name, 4, path=str(tmp_path / "t"))
    assert len(list((tmp_path / "t").glob("*.parquet"))) == 4
    bucketed.write_bucketed(df.select("signup_date", "hs_user_id"), name, 4, append=True)
    assert len(list((tmp_path / "t").glob("*.parquet"))) == 8
    assert spark.table(name).groupBy("hs_user_id").count().filter("count = 2").count() == 1000


def test_other_cuts_are_refused(spark, made, name, tmp_path):
    bucketed.write_bucketed(made, name, 4, path=str(tmp_path / "t"))
    with pytest.raises(ValueError):
        bucketed.write_bucketed(made, name, 8, append=True)
    with pytest.raises(ValueError):
        bucketed.write_bucketed(made, name, 4, ("hs_user_id",), append=True)
    assert spark.table(name).count() == 5


def test_an_empty_table(spark, made, name, tmp_path):
    bucketed.write_bucketed(made.filter("false"), name, 4, path=str(tmp_path / "t"))
    assert spark.table(name).count() == 0


def above(lines, at):
    """Plan lines from the one above ``lines[at]`` to the join that it feeds."""
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    level = depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < level:
            level = depth(line)
            yield line
            if "Join" in line:
                return


@pytest.mark.parametrize("build", [registered._training, registered._scoring])
def test_no_shuffle_of_features(spark, build):
    """Neither feature table is shuffled, and the users once for both."""
    data = Fixtures(spark, SMALL)
    on_keys = lambda plan: len(re.findall(
        r"Exchange hashpartitioning\(hs_user_id#\d+L?, signup_date#\d+", plan))
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(build(data, registered._bucketed_features(data)))
        plain = plan_of(build(data))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    lines = plan.split("\n")
    scans = [at for at, line in enumerate(lines) if "Bucketed: true" in line]
    assert len(scans) == 2
    for at in scans:
        path = list(above(lines, at))
        assert "Join" in path[-1] and not any("Exchange" in line for line in path)
    assert on_keys(plan) == on_keys(plain) - 2


def test_keys_are_those_of_the_frames():
    assert frames.KEYS == list(bucketed.FEATURE_KEYS)
