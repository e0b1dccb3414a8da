"""Lapsed subscribers and how they answer win-back campaigns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlift.functions.expressions import (
    FAR_FUTURE, days_from, flag, name_like, or_far_future, same_text, total_offers)
from cohortlift.operators.campaigns import CONTROL
from cohortlift.operators.sequences import (
    BY_DATE, BY_PAID_START, BY_START, first_per, with_next, with_ordinal)
from cohortlift.operators.skew import Heavy, join_spread
from cohortlift.plans.labels import heavy_users

MIN_TENURE_DAYS = 28
CONVERSION_DAYS = 28
RETURN_DAYS = 365


def winback_target(rollup: DataFrame, subscriptions: DataFrame,
                   subscription_type: str = "b2c", heavy: Heavy | None = None) -> DataFrame:
    """Entries that fall between a cancellation and the next paid start.

    ``rollup`` is per (user, control or treatment). ``target`` is 1 when the
    user paid again within 28 days of entry.
    """
    chosen = subscriptions.filter(
        F.col("hs_user_id").isNotNull() & same_text("subscription_type", subscription_type)
    ).select("hs_user_id", "subscription_id", "dt", "free_trial_start_date",
             "free_trial_end_date", "paid_subscription_start_date",
             "paid_subscription_end_date")
    heavy = heavy_users(chosen, heavy)
    # The default fills in for a missing next row only, not for a null in it.
    sequenced = with_next(
        chosen, "hs_user_id", BY_DATE,
        {
            "next_free_trial_start_date": "free_trial_start_date",
            "next_free_trial_end_date": "free_trial_end_date",
            "next_paid_subscription_start_date": "paid_subscription_start_date",
            "next_paid_subscription_end_date": "paid_subscription_end_date",
        },
        default=FAR_FUTURE, heavy=heavy)
    ordered = with_ordinal(sequenced, "hs_user_id", BY_DATE, heavy=heavy)
    ended = F.coalesce("paid_subscription_end_date", "free_trial_end_date")
    entry, returned = F.col("canvas_entry_date"), F.col("next_paid_subscription_start_date")
    joined = join_spread(
        ordered, rollup.withColumnRenamed("external_user_id", "hs_user_id"),
        "hs_user_id", "subscription_id", heavy,
    ).filter(entry.between(ended, returned))
    return joined.select(
        "hs_user_id",
        ended.alias("subscription_end_date"),
        "experiment_group",
        *[f"num_offers_{size}" for size in (10, 20, 30, 40)],
        days_from(ended, entry).alias("days_since_cancel"),
        days_from("dt", ended).alias("tenure_at_cancel"),
        (F.col("sub_rank") - 1).alias("num_previous_subscriptions"),
        flag(days_from(entry, returned) <= CONVERSION_DAYS).alias("target"),
    )


def paid_sequence(subscriptions: DataFrame, country: str = "us",
                  subscription_type: str = "b2c", heavy: Heavy = ()) -> DataFrame:
    """Subscriptions of one market with next paid start and next voucher.

    The next paid start follows the order of paid starts, unpaid rows first;
    the next voucher follows the order in which subscriptions were taken out.
    """
    market = subscriptions.filter(
        same_text("country_code", country) & same_text("subscription_type", subscription_type)
    ).select("hs_user_id", *BY_START, "voucher_code", "plan_initial_term_months",
             "paid_subscription_start_date", "paid_subscription_end_date")
    paid = with_next(market, "hs_user_id", BY_PAID_START,
                     {"next_paid_subscription_start_date": "paid_subscription_start_date"},
                     heavy=heavy)
    return with_next(paid, "hs_user_id", BY_START,
                     {"next_voucher_code": "voucher_code"}, heavy=heavy)


def last_lapse(rollup: DataFrame, sequenced: DataFrame, ended_from, ended_to,
               min_tenure: int = MIN_TENURE_DAYS, heavy: Heavy = ()) -> DataFrame:
    """One row per user: the paid plan that ended closest before an entry."""
    ended = F.col("paid_subscription_end_date")
    # These tests concern the subscription alone and belong before the join.
    candidates = sequenced.filter(
        ended.between(F.lit(ended_from), F.lit(ended_to))
        & (days_from("paid_subscription_start_date", ended) >= min_tenure))
    joined = join_spread(
        candidates, rollup.withColumnRenamed("external_user_id", "hs_user_id"),
        "hs_user_id", "subscription_id", heavy,
    ).filter(F.col("canvas_entry_date") >= ended)
    return first_per(
        joined, "hs_user_id", days_from(ended, "canvas_entry_date"),
        *[F.col(c).asc_nulls_first() for c in BY_START + ["canvas_variation_name"]])


def lapsed_users(rollup: DataFrame, subscriptions: DataFrame, ended_from, ended_to,
                 country: str = "us", subscription_type: str = "b2c",
                 heavy: Heavy | None = None) -> DataFrame:
    """Last lapse per user with next paid start and voucher, for all reports."""
    heavy = heavy_users(subscriptions, heavy)
    sequenced = paid_sequence(subscriptions, country, subscription_type, heavy)
    return last_lapse(rollup, sequenced, ended_from, ended_to, heavy=heavy)


def in_offer_variation(winback_pattern: str = "%winback%") -> Column:
    """Variation names that carry an offer.

    One report writes the pattern without wildcards, which matches only the
    name 'winback' itself; pass ``"winback"`` for that one.
    """
    name = "canvas_variation_name"
    return (name_like(name, winback_pattern) | name_like(name, "%10%")
            | name_like(name, "%40%"))


def not_returned_before_lapse() -> Column:
    return or_far_future("next_paid_subscription_start_date") >= F.col("paid_subscription_end_date")


def _delays() -> list[Column]:
    ended = F.col("paid_subscription_end_date")
    returned = or_far_future("next_paid_subscription_start_date")
    return [
        F.col("hs_user_id"),
        F.col("plan_initial_term_months"),
        days_from("dt", ended).alias("tenure_at_cancellation"),
        days_from(ended, returned).alias("days_until_return__from_previous_subscription_end_date"),
        days_from("first_email_date", returned).alias("days_until_return__from_first_email_date"),
    ]


def _back_within(days: int) -> Column:
    return days_from("paid_subscription_end_date",
                     or_far_future("next_paid_subscription_start_date")) <= days


def control_responders(lapsed: DataFrame) -> DataFrame:
    """Control users who paid again within a year of lapsing."""
    return lapsed.filter(
        (F.col("canvas_variation_name") == CONTROL)
        & (F.col("next_paid_subscription_start_date") >= F.col("paid_subscription_end_date"))
        & _back_within(RETURN_DAYS)
    ).select(*_delays())


def treatment_responders(lapsed: DataFrame, winback_pattern: str = "winback") -> DataFrame:
    """Users shown an offer who paid again within a year of lapsing."""
    return lapsed.filter(
        in_offer_variation(winback_pattern)
        & (total_offers() > 0)
        & not_returned_before_lapse()
        & _back_within(RETURN_DAYS)
    ).select(
        *_delays(),
        days_from("paid_subscription_end_date", "first_email_date")
        .alias("days_until_email__from_subscription_end_date"),
    )
