"""Interval joins and the funnel against the direct form on edge tables."""

import random

import pytest
from pyspark.sql import functions as F

from cohortlift.functions.expressions import FAR_FUTURE
from cohortlift.operators.campaigns import dropout_rollup, winback_group_rollup, winback_rollup
from cohortlift.operators.intervals import join_running
from cohortlift.operators.numbering import tasks_for
from cohortlift.plans.funnel import MEASURES, campaign_funnel, subscription_sequence
from cohortlift.plans.winback import winback_target
from conftest import day, rows
from registry.long_forms import funnel_by_fan_out, running_by_range
from test_labels import EVENT, SUB, event


@pytest.fixture(scope="module")
def subs(spark):
    pick = random.Random(2)
    data = []
    for number in range(120):
        user = pick.choice([1, 1, 2, 3, 4])
        start = f"2021-01-{pick.randint(1, 15):02d}"
        paid = f"2021-01-{pick.randint(1, 28):02d}" if pick.random() < .6 else None
        data.append((user, number, day(start), None, None, None, None, None, day(paid), None))
    return spark.createDataFrame(data, SUB)


@pytest.fixture(scope="module")
def events(spark):
    pick = random.Random(4)
    names = list(MEASURES.values())
    data = []
    for _ in range(400):
        canvas = pick.choice([1, 2, 3])
        name = {1: "Email Winback A", 2: "Email Winback A", 3: "Other"}[canvas]
        data.append((pick.choice([1, 2, 3, 5]), day(f"2021-01-{pick.randint(1, 20):02d}"), canvas,
                     name, pick.choice(["Control", "control", "Offer 40", None]),
                     pick.choice(names[:1] * 3 + names), "offer_10", False))
    return spark.createDataFrame(data, EVENT)


@pytest.fixture(scope="module")
def campaigns_table(spark):
    return spark.createDataFrame(
        [(1, "Email Winback A", day("2021-01-01")), (2, "Email Winback A", day("2021-01-01")),
         (3, "Other", day("2021-01-01"))], "id long, name string, created_at date"
    ).withColumns({"first_entry": F.col("created_at"), "last_entry": F.col("created_at")})


def test_running_subscriptions_on_edges(events, subs):
    """Ties on the start day, boundary days, days before the first start."""
    asked = events.select(F.col("external_user_id").alias("hs_user_id"),
                          F.col("dt").alias("event_date"), "event_name")
    sequenced = subscription_sequence(subs)
    got, want = join_running(asked, sequenced), running_by_range(asked, sequenced)
    assert rows(got) == rows(want) and got.count() > 100


def test_boundary_event_matches_two(spark):
    subs = spark.createDataFrame(
        [(1, 1, day("2021-01-01"), *[None] * 7), (1, 2, day("2021-01-10"), *[None] * 7)], SUB)
    asked = spark.createDataFrame(
        [(1, day("2021-01-10")), (1, day("2021-01-05")), (1, day("2020-12-31"))],
        "hs_user_id long, event_date date")
    got = join_running(asked, subscription_sequence(subs))
    assert sorted((str(r["event_date"]), r["subscription_id"]) for r in got.collect()) == [
        ("2021-01-05", 1), ("2021-01-10", 1), ("2021-01-10", 2)]


def test_funnel_is_the_fan_out(events, campaigns_table, subs):
    got = campaign_funnel(events, campaigns_table, subs, heavy=[])
    want = funnel_by_fan_out(events, campaigns_table, subs)
    assert rows(got) == rows(want)
    assert rows(campaign_funnel(events, campaigns_table, subs, heavy=[1])) == rows(want)
    assert got.first()["treatment_canvas_entries"] > 0 and got.first()["control_conversions"] > 0


def test_funnel_tasks_grow_with_the_rows(spark, events, campaigns_table, subs):
    assert tasks_for(spark.range(1000), 10) == 100 and tasks_for(spark.range(5), 10) == 8
    plan = campaign_funnel(events, campaigns_table, subs, heavy=[])._jdf.queryExecution().executedPlan().toString()
    # Subscriptions, events and the timeline: none is joined into larger partitions.
    assert plan.count("REPARTITION_BY_NUM") >= 3


def test_winback_target_default_covers_only_a_missing_row(spark):
    rollup = spark.createDataFrame(
        [(1, "control", day("2021-03-01")), (2, "treatment", day("2021-03-01"))],
        "external_user_id long, experiment_group string, canvas_entry_date date"
    ).withColumns({f"num_offers_{s}": F.lit(1) for s in (10, 20, 30, 40)})
    subs = spark.createDataFrame([
        (1, 1, day("2021-01-01"), None, None, None, None, None, day("2021-01-01"), day("2021-02-01")),
        # user 2 has a next subscription that was never paid: a null, not a gap
        (2, 2, day("2021-01-01"), None, None, None, None, None, day("2021-01-01"), day("2021-02-01")),
        (2, 3, day("2021-06-01"), None, None, None, day("2021-06-01"), day("2021-06-08"), None, None),
    ], SUB).withColumn("subscription_type", F.lit("B2C"))
    got = winback_target(rollup, subs, heavy=[])
    assert [(r["hs_user_id"], r["days_since_cancel"], r["num_previous_subscriptions"], r["target"])
            for r in got.collect()] == [(1, 28, 0, 0)]


def test_rollups_on_edges(spark):
    events = spark.createDataFrame([
        event(1, "2021-01-05", "Control", canvas="Email Winback"),
        event(1, "2021-01-02", "Control", "users_messages_email_delivery", "offer_10", "Email Winback"),
        event(2, "2021-01-03", "Offer 40", "users_messages_email_delivery", "offer_2040", "Email Winback"),
        event(3, "2021-01-03", None, step="wait", canvas="Email Winback"),
        event(4, "2021-01-04", "Control", step="wait", canvas="Email Winback"),
    ], EVENT)
    by_user = {r["external_user_id"]: r for r in winback_group_rollup(events).collect()}
    # A null variation counts as treatment; without an offer it drops out.
    assert set(by_user) == {1, 2, 4}
    assert by_user[1]["test_date"] == day("2021-01-05")
    assert by_user[1]["first_email_date"] == day("2021-01-02")
    assert by_user[2]["canvas_entry_date"] is None and by_user[2]["test_date"] == day("2021-01-03")
    assert (by_user[2]["num_offers_20"], by_user[2]["num_offers_40"], by_user[2]["num_offers_10"]) == (1, 1, 0)
    # No entry date: the date test drops the user.
    assert {r["external_user_id"] for r in winback_rollup(events, day("2021-01-01")).collect()} == {1, 3, 4}
    assert dropout_rollup(events, day("2021-01-01"), day("2021-01-31")).count() == 0
    assert FAR_FUTURE.year == 9999
