"""Following a running experiment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlift.operators.campaigns import ENTRY_OR_DELIVERY, choose_events
from cohortlift.plans.export import latest_scores


def events_by_uplift_bin(events: DataFrame, scores: DataFrame, *, name_pattern=None,
                         canvas_id=None, since=None) -> DataFrame:
    """Entries and deliveries by variation, control flag and uplift bin.

    Events are counted per user before they meet the user's newest score.
    """
    chosen = choose_events(events, name_pattern=name_pattern, canvas_id=canvas_id,
                           kinds=ENTRY_OR_DELIVERY, begin=since)
    per_user = chosen.groupBy(
        F.col("external_user_id").alias("hs_user_id"), "canvas_variation_name",
        "in_control_group").count()
    return (
        per_user.join(latest_scores(scores), "hs_user_id")
        .groupBy("canvas_variation_name", "in_control_group", "uplift_score_bin")
        # A user has one row per variation and flag, and one score.
        .agg(F.sum("count").alias("events"), F.count("hs_user_id").alias("users"))
        .orderBy("canvas_variation_name", "in_control_group", "uplift_score_bin")
    )


def events_by_variation(events: DataFrame, **choice) -> DataFrame:
    """Entries and deliveries by variation and control flag."""
    return (
        choose_events(events, kinds=ENTRY_OR_DELIVERY, **choice)
        .groupBy("canvas_variation_name", "in_control_group").count()
        .orderBy("canvas_variation_name", "in_control_group")
    )


def high_uplift_signups(scores: DataFrame, above_bin: int = 5) -> DataFrame:
    """Users in the upper bins per signup date."""
    return (
        scores.filter(F.col("uplift_score_bin") > above_bin)
        .groupBy("signup_date").count().orderBy("signup_date")
    )
