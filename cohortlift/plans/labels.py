"""Who came back after a free trial, with or without an offer."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlift.functions.expressions import days_from, or_far_future, voucher_discount
from cohortlift.operators.campaigns import CONTROL, DROPOUT_NAMES, dropout_rollup
from cohortlift.operators.sequences import BY_START, first_per, with_next
from cohortlift.operators.skew import Heavy, heavy_keys, join_spread

# Days after campaign entry within which a subscription counts. A value of its
# own, apart from the horizon.
ENTRY_WINDOW_DAYS = 42

LABEL_COLUMNS = [
    "hs_user_id", "signup_date", "experiment_group", "discount_redeemed",
    "num_offers_20", "num_offers_30", "num_offers_40",
]

NEXTS = {
    "next_voucher_code": "voucher_code",
    "next_free_trial_start_date": "free_trial_start_date",
    "next_free_trial_end_date": "free_trial_end_date",
    "next_paid_subscription_start_date": "paid_subscription_start_date",
    "next_paid_subscription_end_date": "paid_subscription_end_date",
}


def heavy_users(subscriptions: DataFrame, given: Heavy | None) -> Heavy:
    return heavy_keys(subscriptions, "hs_user_id") if given is None else given


def subscriptions_after_entry(rollup: DataFrame, subscriptions: DataFrame,
                              window_days: int, heavy: Heavy) -> DataFrame:
    """Each user's subscriptions within the window after entry, nearest first.

    Next values look only at rows inside the window, so they are taken after
    the join.
    """
    users = rollup.withColumnRenamed("external_user_id", "hs_user_id")
    entry = F.col("canvas_entry_date")
    joined = join_spread(
        subscriptions.select(
            "hs_user_id", *BY_START, "voucher_code", "free_trial_start_date",
            "free_trial_end_date", "paid_subscription_start_date",
            "paid_subscription_end_date"),
        users, "hs_user_id", "subscription_id", heavy,
    ).filter(F.col("dt").between(entry, F.date_add(entry, window_days)))
    # A user in two variations has a subscription twice; the variation is then
    # the last tie-break.
    return with_next(joined, "hs_user_id", BY_START + ["canvas_variation_name"],
                     NEXTS, heavy=heavy)


def nearest_after_entry(rollup: DataFrame, subscriptions: DataFrame,
                        window_days: int = ENTRY_WINDOW_DAYS,
                        heavy: Heavy = ()) -> DataFrame:
    """One row per user: the subscription closest after campaign entry."""
    sequenced = subscriptions_after_entry(rollup, subscriptions, window_days, heavy)
    return first_per(
        sequenced, "hs_user_id",
        days_from("canvas_entry_date", "dt"),
        *[F.col(column).asc_nulls_first() for column in BY_START + ["canvas_variation_name"]])


def label_groups(nearest: DataFrame, horizon: int) -> DataFrame:
    """Label one row per user in a single pass; unlabelled users drop out.

    Control and treatment exclude each other (a null variation is neither), and
    so do late and soon. The two non-responder rules differ: control only asks
    that the trial did not turn into a paid plan the day it ended.
    """
    variation = F.col("canvas_variation_name")
    on_trial = F.col("free_trial_start_date").isNotNull()
    unpaid = F.col("paid_subscription_start_date").isNull()
    no_other_trial = F.col("next_free_trial_start_date").isNull()
    not_renewed = F.col("free_trial_end_date") != or_far_future("paid_subscription_start_date")
    wait = days_from("free_trial_end_date", or_far_future("next_paid_subscription_start_date"))
    control = (variation == CONTROL) & on_trial
    treated = (variation != CONTROL) & on_trial
    late, soon = wait > horizon, wait <= horizon
    group = (
        F.when(control & late & not_renewed, "CN")
        .when(treated & late & unpaid, "TN")
        .when(control & soon & unpaid & no_other_trial, "CR")
        .when(treated & soon & unpaid & no_other_trial, "TR")
    )
    discount = voucher_discount("next_voucher_code")
    return (
        nearest.withColumn("experiment_group", group)
        .filter(F.col("experiment_group").isNotNull())
        .withColumn(
            "discount_redeemed",   # left null for treated responders
            F.when(F.col("experiment_group") == "TR", discount)
            .otherwise(F.coalesce(discount, F.lit(0))))
        .withColumnRenamed("dt", "signup_date")
        .select(*LABEL_COLUMNS)
    )


def experiment_labels(events: DataFrame, subscriptions: DataFrame, begin: dt.date,
                      end: dt.date, horizon: int = 42,
                      window_days: int = ENTRY_WINDOW_DAYS, *,
                      name_pattern: str = DROPOUT_NAMES, canvas_id=None,
                      heavy: Heavy | None = None) -> DataFrame:
    """CN, TN, CR and TR users of the campaigns entered from begin to end.

    The campaign is chosen by name pattern, or by id if one is given.
    """
    rollup = dropout_rollup(events, begin, end, name_pattern=name_pattern, canvas_id=canvas_id)
    # Entries lie in [begin, end], so only these start dates can match; said
    # here so that the scan can skip the rest.
    reachable = subscriptions.filter(
        F.col("dt").between(F.lit(begin), F.lit(end + dt.timedelta(days=window_days))))
    nearest = nearest_after_entry(rollup, reachable, window_days,
                                  heavy_users(reachable, heavy))
    return label_groups(nearest, horizon)
