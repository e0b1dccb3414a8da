"""User cohorts, and the frames a model is trained and scored on."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlift.functions.expressions import (
    largest_offer, month_start, plan_length, same_text, subscriber_kind)
from cohortlift.operators.features import feature_columns, fill_missing, with_week_sums
from cohortlift.operators.skew import Heavy
from cohortlift.plans.labels import experiment_labels
from cohortlift.sources.tables import features_between

DROPOUT_COHORT = "free trial drop out"
KEYS = ["hs_user_id", "signup_date"]
GROUPS = ["CN", "CR", "TN", "TR"]
# Offer assumed for users who have not been offered anything yet.
SCORING_OFFER = 20
TRIAL_LENGTHS = (7, 14)


def dropout_cohort(subscriptions: DataFrame, country: str, subscription_type: str,
                   begin: dt.date, end: dt.date) -> DataFrame:
    """Subscriptions of one market whose free trial began from begin to end."""
    return (
        subscriptions.filter(
            same_text("subscription_type", subscription_type)
            & same_text("country_code", country)
            & F.col("free_trial_start_date").between(F.lit(begin), F.lit(end)))
        .withColumns({"signup_date": F.col("dt"), "signup_month": month_start("dt")})
    )


# The win-back cohort is unfinished in what this follows, so it is not offered.
COHORTS = {DROPOUT_COHORT: dropout_cohort}


def user_cohort(name: str, subscriptions: DataFrame, country: str, subscription_type: str,
                begin: dt.date, end: dt.date) -> DataFrame:
    if name not in COHORTS:
        raise ValueError(f"unknown cohort {name!r}; there are {sorted(COHORTS)}")
    return COHORTS[name](subscriptions, country, subscription_type, begin, end)


def _with_features(users: DataFrame, engagement: DataFrame, events: DataFrame,
                   begin: dt.date, end: dt.date) -> DataFrame:
    return (
        users.join(features_between(engagement, begin, end), KEYS, "left")
        .join(features_between(events, begin, end), KEYS, "left")
    )


def _with_categories(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "plan_renewal_term_months_c": plan_length("plan_renewal_term_months"),
        "renewal_c": subscriber_kind("renewal_count"),
    })


def training_frame(events: DataFrame, subscriptions: DataFrame, engagement: DataFrame,
                   event_features: DataFrame, begin: dt.date, end: dt.date, *,
                   cohort: str = DROPOUT_COHORT, country: str = "us",
                   subscription_type: str = "b2c", horizon: int = 42,
                   window_days: int = 42, heavy: Heavy | None = None) -> DataFrame:
    """Labelled users with categories, weekly features and 0/1 group columns."""
    users = user_cohort(cohort, subscriptions, country, subscription_type, begin, end)
    # Not a feature and differs per row kind, so the trial filter can come first.
    users = users.filter(F.col("free_trial_days").isin(*TRIAL_LENGTHS))
    labels = experiment_labels(events, subscriptions, begin, end, horizon, window_days,
                               heavy=heavy)
    joined = _with_features(users.join(labels, KEYS), engagement, event_features, begin, end)
    described = fill_missing(_with_categories(joined).withColumn(
        "max_discount_offered_c", largest_offer()))
    return with_week_sums(described).withColumns({
        f"experiment_group_{group}": F.when(F.col("experiment_group") == group, 1).otherwise(0)
        for group in GROUPS
    })


def scoring_frame(subscriptions: DataFrame, engagement: DataFrame, event_features: DataFrame,
                  begin: dt.date, end: dt.date | None = None, *,
                  cohort: str = DROPOUT_COHORT, country: str = "us",
                  subscription_type: str = "b2c",
                  trial_lengths: tuple | None = None) -> DataFrame:
    """Users to score; one signup date unless ``end`` is given.

    ``trial_lengths`` keeps only trials of those lengths; all by default.
    """
    end = end or begin
    users = user_cohort(cohort, subscriptions, country, subscription_type, begin, end)
    if trial_lengths is not None:
        users = users.filter(F.col("free_trial_days").isin(*trial_lengths))
    joined = _with_features(users, engagement, event_features, begin, end)
    described = fill_missing(_with_categories(joined)).withColumn(
        "max_discount_offered_c", F.lit(SCORING_OFFER))
    return with_week_sums(described)


def feature_part(frame: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Keys, named extras and the model's feature columns."""
    return frame.select(*KEYS, *extra, *feature_columns(frame.columns))


def split_by_date(frame: DataFrame, train_end: dt.date, test_end: dt.date | None = None):
    """Train (up to train_end), test (after it) and final (up to test_end) rows."""
    date = F.col("signup_date")
    final = frame if test_end is None else frame.filter(date <= F.lit(test_end))
    return frame.filter(date <= F.lit(train_end)), frame.filter(date > F.lit(train_end)), final


def split_by_arm(frame: DataFrame):
    """Treatment rows (TN, TR) and control rows (CN, CR)."""
    group = F.col("experiment_group")
    return frame.filter(group.isin("TN", "TR")), frame.filter(group.isin("CN", "CR"))
