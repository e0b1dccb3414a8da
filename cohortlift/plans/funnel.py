"""Historic performance of win-back campaigns, one row per campaign."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlift.functions.expressions import days_from, name_like, or_far_future
from cohortlift.operators.campaigns import WINBACK_NAMES
from cohortlift.operators.intervals import starts_last_that_day
from cohortlift.operators.numbering import tasks_for
from cohortlift.operators.sequences import BY_DATE, with_next
from cohortlift.operators.skew import Heavy, any_heavy, broadcast_checked
from cohortlift.plans.labels import heavy_users

# Measure name and the event it counts, in report order.
MEASURES = {
    "canvas_entries": "users_canvas_entry",
    "emails_delivered": "users_messages_email_delivery",
    "emails_opened": "users_messages_email_open",
    "emails_clicked": "users_messages_email_click",
    "emails_unsubscribed": "users_messages_email_unsubscribe",
    "emails_marked_as_spam": "users_messages_email_mark_as_spam",
    "webhook_sent": "users_messages_webhook_send",
    "canvas_conversion": "users_canvas_conversion",
}
ARMS = ("treatment", "control")
CONVERSION_DAYS = 28


def winback_campaigns(campaigns: DataFrame) -> DataFrame:
    return campaigns.filter(name_like("name", WINBACK_NAMES)).select(
        F.col("id").alias("canvas_id"),
        "name",
        F.col("created_at").cast("date").alias("created_date"),
        F.col("first_entry").cast("date").alias("first_entry_date"),
        F.col("last_entry").cast("date").alias("last_entry_date"),
    )


def subscription_sequence(subscriptions: DataFrame, heavy: Heavy = ()) -> DataFrame:
    """Subscriptions with the start, paid start and paid end of the next one."""
    narrow = subscriptions.select(
        "hs_user_id", "subscription_id", "dt", "free_trial_start_date",
        "free_trial_end_date", "paid_subscription_start_date",
        "paid_subscription_end_date")
    return with_next(
        narrow if any_heavy(heavy) else narrow.repartition(tasks_for(narrow), "hs_user_id"),
        "hs_user_id", BY_DATE,
        {
            "next_subscription_start_date": "dt",
            "next_paid_subscription_start_date": "paid_subscription_start_date",
            "next_paid_subscription_end_date": "paid_subscription_end_date",
        },
        heavy=heavy)


def _subscription_days(sequenced: DataFrame) -> DataFrame:
    """One row per (user, start day): what an event on or after it needs.

    ``on_day``/``on_day_next``: subscriptions running on that very day and
    their earliest next paid start. ``after_next``: the next paid start of the
    one that keeps running.
    """
    next_paid = or_far_future("next_paid_subscription_start_date")
    days = sequenced.filter(F.col("dt").isNotNull()).groupBy("hs_user_id", "dt").agg(
        F.count("*").alias("starts"),
        F.min(next_paid).alias("soonest"),
        # One row per day; a maximum of it keeps the aggregate hashed.
        F.max(F.when(starts_last_that_day(), next_paid)).alias("after_next"),
    )
    previous = F.lag("after_next").over(Window.partitionBy("hs_user_id").orderBy("dt"))
    return days.select(
        "hs_user_id", F.col("dt").alias("day"), "after_next",
        (F.col("starts") + F.when(previous.isNotNull(), 1).otherwise(0)).alias("on_day"),
        F.least("soonest", previous).alias("on_day_next"),
    )


def _event_days(events: DataFrame, winback: DataFrame, tasks: int) -> DataFrame:
    """Event counts per (user, campaign, arm, day).

    Events go to tasks by user, campaign and day, so many events of one user
    do not meet in one task, and a task counts a bounded number of them.
    """
    variation = F.lower("canvas_variation_name")
    arm = F.when(variation != "control", "treatment").when(variation == "control", "control")
    entered = events.filter(F.col("external_user_id").isNotNull()).select(
        F.col("external_user_id").alias("hs_user_id"), "canvas_id", "canvas_name",
        arm.alias("arm"), F.col("dt").alias("day"), "event_name")
    return (
        entered.repartition(tasks, "hs_user_id", "canvas_id", "day")
        .join(winback.select("canvas_id", "created_date"), "canvas_id")
        .groupBy("hs_user_id", "canvas_id", "canvas_name", "created_date", "arm", "day")
        .agg(*[
            F.count_if(F.col("event_name") == event).alias(measure)
            for measure, event in MEASURES.items()
        ])
    )


def campaign_funnel(events: DataFrame, campaigns: DataFrame, subscriptions: DataFrame,
                    heavy: Heavy | None = None) -> DataFrame:
    """Eight event counts and the converted users, per campaign and arm.

    Every entry is matched to the subscriptions running on its day, and each
    match counts all events of that user in that campaign again. The counts of
    that fan-out are products (matches times events), so it is never built:
    events are counted per day first, and from there one window per user, over
    at most a few rows per calendar day, does the rest.
    """
    # One winback row per campaign id; created_date stays a plain attribute.
    winback = broadcast_checked(winback_campaigns(campaigns))
    starts = _subscription_days(
        subscription_sequence(subscriptions, heavy_users(subscriptions, heavy)))
    tasks = tasks_for(events)
    days = _event_days(events, winback, tasks)

    start_state = F.struct("day", "after_next", "on_day", "on_day_next")
    timeline = days.withColumn("_state", F.lit(None)).unionByName(
        starts.select("hs_user_id", "day", start_state.alias("_state")),
        allowMissingColumns=True).repartition(tasks, "hs_user_id")
    so_far = (
        Window.partitionBy("hs_user_id").orderBy("day", F.col("_state").isNull())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    state = F.last("_state", ignorenulls=True).over(so_far)
    placed = timeline.withColumn("_now", state).filter(F.col("canvas_id").isNotNull())

    starts_today = F.col("_now.day") == F.col("day")
    matches = (
        F.when(F.col("_now").isNull(), 0)
        .when(starts_today, F.col("_now.on_day"))
        .otherwise(1)
    )
    next_paid = F.when(starts_today, F.col("_now.on_day_next")).otherwise(F.col("_now.after_next"))
    entered = (F.col("canvas_entries") > 0) & F.col("_now").isNotNull()
    converted = entered & (days_from("day", next_paid) <= CONVERSION_DAYS)

    per_user = placed.groupBy(
        "hs_user_id", "canvas_id", "canvas_name", "created_date", "arm"
    ).agg(
        F.sum(F.col("canvas_entries") * matches).alias("_entries"),
        F.max(converted).alias("_converted"),
        *[F.sum(measure).alias(measure) for measure in MEASURES],
    )
    # Events count whatever their own arm or name, so total them per campaign.
    whole = Window.partitionBy("hs_user_id", "canvas_id", "created_date")
    multiplied = per_user.select(
        "hs_user_id", "canvas_name", "created_date", "arm", "_entries", "_converted",
        *[
            (F.sum(measure).over(whole) * F.col("_entries")).alias(measure)
            for measure in MEASURES
        ],
    ).filter(F.col("_entries") > 0)
    # A user converted in two campaigns of one name counts once.
    per_name = multiplied.groupBy("hs_user_id", "canvas_name", "created_date", "arm").agg(
        F.max("_converted").alias("_converted"),
        *[F.sum(measure).alias(measure) for measure in MEASURES],
    )
    report = []
    for arm in ARMS:
        in_arm = F.col("arm") == arm
        report += [
            F.coalesce(F.sum(F.when(in_arm, F.col(measure))), F.lit(0)).alias(f"{arm}_{measure}")
            for measure in MEASURES
        ]
        report.append(F.count_if(in_arm & F.col("_converted")).alias(f"{arm}_conversions"))
    return (
        per_name.groupBy("canvas_name", F.col("created_date").alias("canvas_created_date"))
        .agg(*report)
        .orderBy(F.desc("canvas_created_date"))
    )
