"""Joining dated events to the subscription that was running on the day.

A subscription runs from its start to the start of the user's next one, both
ends included, so the intervals of a user tile the calendar. On any day they
are: every subscription that starts that day, and the last one that started
before. That turns the range join into an as-of lookup per (user, day) and an
equality join, and no user's events are ever compared with all of their
subscriptions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def starts_last_that_day() -> Column:
    """True for the last of a user's subscriptions that start on one day."""
    following = F.col("next_subscription_start_date")
    return F.col("dt").isNotNull() & (following.isNull() | (following != F.col("dt")))


def running_on(days: DataFrame, subscriptions: DataFrame, key: str = "hs_user_id",
               day: str = "event_date") -> DataFrame:
    """The subscription rows running on each (user, day) of ``days``.

    ``days`` has distinct (key, day) rows; ``subscriptions`` are in sequence,
    with ``next_subscription_start_date``. The result repeats a day once per
    running subscription and has no row for a day before the first one.
    """
    carried = F.struct(*[c for c in subscriptions.columns if c != key])
    # One row per (user, day): the one that keeps running after that day.
    last_of_day = subscriptions.filter(starts_last_that_day()).select(
        key, F.col("dt").alias(day), carried.alias("_subscription"), F.lit(1).alias("_kind"))
    asked = days.select(
        key, day, F.lit(None).cast(last_of_day.schema["_subscription"].dataType)
        .alias("_subscription"), F.lit(0).alias("_kind"))
    # Days asked about sort before the same day's subscription, so they see
    # strictly earlier ones. A user has at most two rows per calendar day here.
    earlier = (
        Window.partitionBy(key).orderBy(day, "_kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = (
        last_of_day.unionByName(asked)
        .withColumn("_subscription", F.last("_subscription", ignorenulls=True).over(earlier))
        .filter((F.col("_kind") == 0) & F.col("_subscription").isNotNull())
        .select(key, day, "_subscription.*")
    )
    same_day = subscriptions.withColumn(day, F.col("dt")).join(days, [key, day])
    return before.unionByName(same_day.select(*before.columns))


def join_running(events: DataFrame, subscriptions: DataFrame, key: str = "hs_user_id",
                 day: str = "event_date") -> DataFrame:
    """Inner join of events with the subscriptions running on their day."""
    days = events.select(key, day).filter(F.col(day).isNotNull()).distinct()
    return events.join(running_on(days, subscriptions, key, day), [key, day])
