"""Typical first-week engagement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlift.functions.expressions import same_text
from cohortlift.operators.features import eight_day_starts
from cohortlift.operators.numbering import running_totals


def median_daily_total(engagement: DataFrame, since, name: str = "content_starts") -> DataFrame:
    """Approximate median of the eight-day sum; a null day makes a row drop out."""
    days = [F.col(f"day{day}_{name}") for day in range(8)]
    total = reduce(lambda left, right: left + right, days)
    return engagement.filter(F.col("signup_date") >= F.lit(since)).agg(
        F.percentile_approx(total, 0.5).alias("median_starts"))


def weighted_median(counted: DataFrame, value: str, weight: str) -> DataFrame:
    """Smallest value with at least half the total weight at or below it."""
    summed, totals = running_totals(
        counted.groupBy(value).agg(F.sum(weight).alias("_weight")),
        [F.col(value)], {"_upto": F.col("_weight")})
    return (
        summed.filter(F.col("_upto") * 2 >= totals["_upto"])
        .agg(F.min(value).alias("median_starts"))
    )


def median_week1(subscriptions: DataFrame, engagement: DataFrame, since,
                 country: str = "us", subscription_type: str = "b2c") -> DataFrame:
    """Median eight-day starts over subscriptions left-joined with engagement.

    The join pairs every subscription of a user with every engagement row of
    theirs. The pairs are only counted, so both sides are counted per user
    first and the counts multiplied; a user with no engagement counts as 0.
    """
    subs = (
        subscriptions.filter(
            (F.col("dt") >= F.lit(since))
            & same_text("subscription_type", subscription_type)
            & same_text("country_code", country))
        .groupBy("hs_user_id").agg(F.count("*").alias("subscriptions"))
    )
    starts = (
        engagement.filter(F.col("signup_date") >= F.lit(since))
        .groupBy("hs_user_id", eight_day_starts().alias("week1_content_starts"))
        .agg(F.count("*").alias("signups"))
    )
    pairs = subs.join(starts, "hs_user_id", "left").select(
        F.coalesce("week1_content_starts", F.lit(0)).alias("week1_content_starts"),
        (F.col("subscriptions") * F.coalesce("signups", F.lit(1))).alias("pairs"))
    return weighted_median(pairs, "week1_content_starts", "pairs")
