"""The direct forms that the short ones in the library replace.

Tests check that both give the same rows; ``bench_forms.py`` times them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlift.functions.expressions import or_far_future, voucher_discount
from cohortlift.plans.funnel import ARMS, MEASURES, subscription_sequence
from cohortlift.plans.labels import LABEL_COLUMNS
from cohortlift.plans.takerate import held_out_users


def labels_by_group(nearest: DataFrame, horizon: int) -> DataFrame:
    """One filter per group, and their union."""
    variation, wait = F.col("canvas_variation_name"), F.datediff(
        or_far_future("next_paid_subscription_start_date"), "free_trial_end_date")
    trial = nearest.filter("free_trial_start_date IS NOT NULL")
    unpaid = trial.filter("paid_subscription_start_date IS NULL")
    once = unpaid.filter("next_free_trial_start_date IS NULL")
    groups = {
        "CN": trial.filter((variation == "Control") & (wait > horizon) & (
            F.col("free_trial_end_date") != or_far_future("paid_subscription_start_date"))),
        "TN": unpaid.filter((variation != "Control") & (wait > horizon)),
        "CR": once.filter((variation == "Control") & (wait <= horizon)),
        "TR": once.filter((variation != "Control") & (wait <= horizon)),
    }
    parts = []
    for group, df in groups.items():
        discount = voucher_discount("next_voucher_code")
        parts.append(
            df.withColumn("experiment_group", F.lit(group))
            .withColumn("discount_redeemed",
                        discount if group == "TR" else F.coalesce(discount, F.lit(0)))
            .withColumnRenamed("dt", "signup_date").select(*LABEL_COLUMNS))
    return reduce(DataFrame.unionByName, parts)


def control_curve_by_day(lapsed: DataFrame) -> DataFrame:
    """A row per held-out user and day of the year, counted."""
    return (
        held_out_users(lapsed)
        .withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(365))))
        .withColumn("hit", (F.datediff(
            or_far_future("next_paid_subscription_start_date"),
            F.date_add("paid_subscription_end_date", F.col("d"))) <= 28).cast("int"))
        .groupBy(F.col("d").alias("days_since_cancel"))
        .agg(F.count("*").alias("users"), F.sum("hit").alias("converted")))


def running_by_range(events: DataFrame, sequenced: DataFrame) -> DataFrame:
    """Every event of a user against every subscription of theirs."""
    return events.join(sequenced, "hs_user_id").filter(F.col("event_date").between(
        F.col("dt"), or_far_future("next_subscription_start_date")))


def funnel_by_fan_out(events: DataFrame, campaigns: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Every matched entry joined to every event of its user and campaign."""
    entries = (
        events.filter("event_name = 'users_canvas_entry'")
        .join(campaigns.filter("lower(name) like '%winback%'").select(
            F.col("id").alias("canvas_id"), F.col("created_at").cast("date").alias("made")), "canvas_id")
        .select(F.col("external_user_id").alias("hs_user_id"), F.col("dt").alias("event_date"),
                "canvas_id", "canvas_name", "canvas_variation_name", "made"))
    matched = running_by_range(entries, subscription_sequence(subscriptions)).select(
        *entries.columns, "next_paid_subscription_start_date")
    fanned = matched.join(
        events.select(F.col("external_user_id").alias("hs_user_id"), "canvas_id", "event_name"),
        ["hs_user_id", "canvas_id"])
    report = []
    for arm, in_arm in zip(ARMS, (F.lower("canvas_variation_name") != "control",
                                  F.lower("canvas_variation_name") == "control")):
        report += [F.count(F.when(in_arm & (F.col("event_name") == e), 1)).alias(f"{arm}_{m}")
                   for m, e in MEASURES.items()]
        soon = F.datediff(or_far_future("next_paid_subscription_start_date"), "event_date") <= 28
        report.append(F.countDistinct(F.when(in_arm & soon, F.col("hs_user_id")))
                      .alias(f"{arm}_conversions"))
    return fanned.groupBy("canvas_name", F.col("made").alias("canvas_created_date")).agg(*report)


def number_in_one_partition(df: DataFrame, *order: str) -> DataFrame:
    return df.withColumn("row_number", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
