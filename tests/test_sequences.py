"""Ordering per user: heavy users must come out as on the ordinary path."""

import random

import pytest
from pyspark.sql import functions as F

from cohortlift.operators.numbering import number_rows, running_totals
from cohortlift.operators.sequences import first_per, with_next, with_ordinal
from cohortlift.operators.skew import broadcast_checked, heavy_keys, join_spread
from conftest import day, plan_of, rows


@pytest.fixture(scope="module")
def subs(spark):
    """User 1 holds a third of the rows, with many ties and nulls; one null user."""
    pick = random.Random(7)
    data = []
    for number in range(900):
        user = 1 if number % 3 == 0 else pick.choice([2, 3, 4, 5, None])
        date = day(f"2020-0{pick.randint(1, 3)}-0{pick.randint(1, 9)}") if pick.random() > .1 else None
        data.append((user, number, date, pick.choice(["a", "b", None])))
    return spark.createDataFrame(data, "hs_user_id long, subscription_id long, dt date, code string")


ORDER = ["dt", "subscription_id"]


@pytest.mark.parametrize("default", [None, "none"])
def test_next_is_the_same_for_heavy_users(subs, default):
    nexts = {"next_code": "code"}
    plain = with_next(subs, "hs_user_id", ORDER, nexts, default)
    heavy = with_next(subs, "hs_user_id", ORDER, nexts, default, heavy=[1, 3])
    assert rows(plain) == rows(heavy)


def test_next_against_python(subs):
    by_user = {}
    for r in subs.collect():
        by_user.setdefault(r["hs_user_id"], []).append(r)
    expected = []
    for user, records in by_user.items():
        records.sort(key=lambda r: (r["dt"] is not None, r["dt"] or day("1970-01-01"),
                                    r["subscription_id"]))
        for this, after in zip(records, records[1:] + [None]):
            expected.append((this["subscription_id"], after["code"] if after else "none"))
    got = with_next(subs, "hs_user_id", ORDER, {"next_code": "code"}, "none", heavy=[1])
    assert sorted((r["subscription_id"], r["next_code"] or "") for r in got.collect()) == sorted(
        (i, c or "") for i, c in expected)


@pytest.mark.parametrize("default", [None, "none"])
def test_heavy_users_in_a_frame(spark, subs, default):
    """Heavy keys need not come to the driver; repeated, unknown and null ones do no harm."""
    heavy = spark.createDataFrame([(1,), (3,), (3,), (77,), (None,)], "id long")
    nexts = {"next_code": "code"}
    assert rows(with_next(subs, "hs_user_id", ORDER, nexts, default)) == rows(
        with_next(subs, "hs_user_id", ORDER, nexts, default, heavy=heavy))
    assert rows(with_ordinal(subs, "hs_user_id", ORDER)) == rows(
        with_ordinal(subs, "hs_user_id", ORDER, heavy=heavy))
    few = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (None, "n")], "hs_user_id long, variation string")
    assert rows(join_spread(subs, few, "hs_user_id", "subscription_id", heavy)) == rows(
        subs.join(few, "hs_user_id"))


def test_ordinal_is_the_same_for_heavy_users(subs):
    assert rows(with_ordinal(subs, "hs_user_id", ORDER)) == rows(
        with_ordinal(subs, "hs_user_id", ORDER, heavy=[1, 2]))


def test_join_spread_is_a_join(spark, subs):
    few = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (9, "w"), (None, "n")],
                                "hs_user_id long, variation string")
    assert rows(join_spread(subs, few, "hs_user_id", "subscription_id", [1, 9])) == rows(
        subs.join(few, "hs_user_id"))


def test_heavy_keys_counts(subs):
    assert rows(heavy_keys(subs, "hs_user_id", at_least=300)) == [(1,)]
    assert heavy_keys(subs, "hs_user_id") == []


def test_heavy_keys_have_no_cap(spark):
    pairs = spark.range(5000).select((F.col("id") / 2).cast("long").alias("hs_user_id"))
    assert heavy_keys(pairs, "hs_user_id", at_least=2).count() == 2500


def test_first_per_limits_before_the_shuffle(subs):
    first = first_per(subs, "hs_user_id", F.col("dt").asc_nulls_last(), "subscription_id")
    plan = plan_of(first)
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert first.count() == 6


def test_row_numbers(subs):
    numbered, total = number_rows(subs, F.desc("subscription_id"))
    assert total == 900
    assert sorted((r["row_number"], r["subscription_id"]) for r in numbered.collect()) == [
        (i + 1, 899 - i) for i in range(900)]


def test_row_numbers_of_nothing(subs):
    numbered, total = number_rows(subs.filter("false"), "subscription_id")
    assert total == 0 and numbered.count() == 0


def test_running_totals(spark):
    df = spark.createDataFrame([(i, i % 4) for i in range(1, 401)], "k int, v int")
    summed, totals = running_totals(df, [F.col("k")], {"upto": F.col("v"), "n": F.lit(1)})
    assert totals == {"upto": sum(i % 4 for i in range(1, 401)), "n": 400}
    running = 0
    for r in sorted(summed.collect(), key=lambda r: r["k"]):
        running += r["v"]
        assert (r["upto"], r["n"]) == (running, r["k"])


def test_broadcast_only_after_a_size_check(spark, subs):
    small = spark.createDataFrame([(1, "x")], "hs_user_id long, v string")
    hint = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hint(broadcast_checked(small)) and not hint(broadcast_checked(subs, most_rows=10))
