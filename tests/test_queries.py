"""Every registered query against its SQL, and what its plan may not contain."""

import math
import re

import duckdb
import pytest

import __spark_entry__ as entry_point
from cohortlift.sources.fixtures import Fixtures
from conftest import SMALL, plan_of
from registry import oracle, queries

TABLES = ["customer", "orders", "lineitem"]
QUERIES = queries.queries()
ORACLE = oracle.oracle_sql()
# Models and random draws; tested by their properties.
NO_SQL = {"uplift_scores", "oversampled_training"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    return value


def ordered(records):
    return sorted(records, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_all_are_offered():
    assert set(QUERIES) <= set(entry_point.queries())
    assert ORACLE.items() <= entry_point.oracle_sql().items()


def test_every_query_has_sql_but_the_random_ones():
    assert set(QUERIES) - set(ORACLE) == NO_SQL
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    cursor = duck.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    columns = sorted(names)
    expected = ordered(
        tuple(normal(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    df = QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == columns
    assert ordered(tuple(normal(r[c]) for c in columns) for r in df.collect()) == expected
    plan = plan_of(df)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert not re.search(r"(BatchEval|ArrowEval|MapInPandas)", plan)


def test_entry_has_the_label_columns(spark):
    df = entry_point.entry(spark)
    assert df.columns == [
        "hs_user_id", "signup_date", "experiment_group", "discount_redeemed",
        "num_offers_20", "num_offers_30", "num_offers_40"]


def test_some_users_are_heavy_in_the_queries_named_so(spark):
    heavy = queries._heavy_users(Fixtures(spark, SMALL), queries.MANY_ROWS)
    assert 0 < heavy.count() < Fixtures(spark, SMALL).subscriptions.select("hs_user_id").distinct().count()
