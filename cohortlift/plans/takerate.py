"""Take rates by the days between lapsing and the campaign."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlift.functions.expressions import (
    days_from, flag, name_like, or_far_future, total_offers)
from cohortlift.operators.binning import (
    assign_bins, bin_bounds, cut_edges, interpolate, quantile_ranks)
from cohortlift.plans.winback import (
    CONVERSION_DAYS, in_offer_variation, not_returned_before_lapse)

# Days after lapsing over which the curves run.
LAST_DAY = 365


def offered_users(lapsed: DataFrame) -> DataFrame:
    return lapsed.filter(
        in_offer_variation() & (total_offers() > 0) & not_returned_before_lapse())


def held_out_users(lapsed: DataFrame) -> DataFrame:
    return lapsed.filter(
        name_like("canvas_variation_name", "%control%") & (total_offers() == 0)
        & not_returned_before_lapse())


def treatment_conversions(lapsed: DataFrame, *, needs_winback_voucher: bool = True) -> DataFrame:
    """Offered users with the days from lapse to first email and a 28-day flag.

    A return before the email counts as well. With ``needs_winback_voucher``
    the next voucher must be a win-back one.
    """
    paid = days_from("first_email_date", or_far_future("next_paid_subscription_start_date"))
    converted = paid <= CONVERSION_DAYS
    if needs_winback_voucher:
        converted = converted & name_like("next_voucher_code", "%winback%")
    return offered_users(lapsed).select(
        "hs_user_id", "paid_subscription_end_date", "next_paid_subscription_start_date",
        "voucher_code", "next_voucher_code", "first_email_date",
        days_from("paid_subscription_end_date", "first_email_date").alias("days_since_cancel"),
        flag(converted).alias("convert_28day_ind"),
    )


def within_year(conversions: DataFrame) -> DataFrame:
    return conversions.filter(F.col("days_since_cancel").between(0, LAST_DAY))


def returns_by_voucher(lapsed: DataFrame) -> DataFrame:
    """Offered users per next voucher. One row per user, so rows are users."""
    return (
        treatment_conversions(lapsed, needs_winback_voucher=False)
        .groupBy("next_voucher_code").agg(F.count("hs_user_id").alias("num_returns"))
    )


def control_curve(lapsed: DataFrame) -> DataFrame:
    """For each day d in 1..365: held-out users, and how many would convert.

    A user asked on day d converts if the next paid start is at most 28 days
    later, so from some day on the answer stays yes. Counting users by that day
    and adding up gives the curve without a row per user and day.
    """
    returned = or_far_future("next_paid_subscription_start_date")
    first_yes = days_from("paid_subscription_end_date", returned) - CONVERSION_DAYS
    per_day = (
        held_out_users(lapsed)
        .groupBy(F.least(F.greatest(first_yes, F.lit(1)), F.lit(LAST_DAY + 1)).alias("day"))
        .agg(F.count("*").alias("switching"))
    )
    calendar = lapsed.sparkSession.range(1, LAST_DAY + 2).select(F.col("id").cast("int").alias("day"))
    # 366 rows from here on, whatever the data.
    up_to = Window.partitionBy(F.lit(0)).orderBy("day")
    everyone = Window.partitionBy(F.lit(0))
    switching = F.coalesce("switching", F.lit(0))
    return (
        calendar.join(per_day, "day", "left")
        .select(
            F.col("day").alias("days_since_cancel"),
            F.sum(switching).over(everyone).alias("users"),
            F.sum(switching).over(up_to).alias("converted"),
        )
        .filter(F.col("days_since_cancel") <= LAST_DAY)
        .filter(F.col("users") > 0)
    )


def _means(binned: DataFrame, users, converted, day_sum, edges) -> DataFrame:
    means = binned.groupBy("bin").agg(
        F.sum(users).alias("users"),
        (F.sum(day_sum) / F.sum(users)).alias("mean_days_since_cancel"),
        (F.sum(converted) / F.sum(users)).alias("convert_28day_rate"),
    )
    return bin_bounds(means, edges)


def treatment_rate_by_bin(conversions: DataFrame, edges: list[float]) -> DataFrame:
    """Mean days and take rate per bin, for quantile or equal-width edges."""
    binned = conversions.withColumn("bin", assign_bins("days_since_cancel", edges))
    return _means(binned, F.lit(1), F.col("convert_28day_ind"),
                  F.col("days_since_cancel"), edges)


def control_rate_by_bin(curve: DataFrame, edges: list[float]) -> DataFrame:
    binned = curve.withColumn("bin", assign_bins("days_since_cancel", edges))
    return _means(binned, F.col("users"), F.col("converted"),
                  F.col("users") * F.col("days_since_cancel"), edges)


def control_quantile_edges(users: int, q: int) -> list[float]:
    """Quantile edges of the days when each day 1..365 occurs ``users`` times."""
    day_at = lambda rank: rank // users + 1
    return [
        interpolate(day_at(rank), day_at(min(rank + 1, LAST_DAY * users - 1)), part)
        for rank, part in quantile_ranks(LAST_DAY * users, q)
    ]


def control_cut_edges(bins: int) -> list[float]:
    return cut_edges(1, LAST_DAY, bins)


def ten_day_bucket(day: str = "days_since_cancel"):
    return (F.floor((F.col(day) - 1) / 10) + 1).alias("ten_day_bucket")


def treatment_rate_by_ten_days(conversions: DataFrame) -> DataFrame:
    return conversions.groupBy(ten_day_bucket()).agg(
        (F.sum("convert_28day_ind") / F.count("*")).alias("take_rate"),
        F.count("hs_user_id").alias("num_users"),   # one row per user
    ).orderBy("ten_day_bucket")


def control_rate_by_ten_days(curve: DataFrame) -> DataFrame:
    """Every held-out user is in every bucket, once per day of it."""
    return curve.groupBy(ten_day_bucket()).agg(
        (F.sum("converted") / F.sum("users")).alias("take_rate"),
        F.max("users").alias("num_users"),
    ).orderBy("ten_day_bucket")
