"""Choosing campaign events and rolling them up per user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlift.functions.expressions import name_like

# Event names and name patterns as they occur in the data.
ENTRY = "users_canvas_entry"
DELIVERY = "users_messages_email_delivery"
ENTRY_OR_DELIVERY = (ENTRY, DELIVERY)
CONTROL = "Control"
DROPOUT_NAMES = "%ftdropout%"
WINBACK_NAMES = "%winback%"
WINBACK_EMAIL_NAMES = "%email%winback%"


def choose_events(events: DataFrame, *, name_pattern: str | None = None, canvas_id=None,
                  kinds=None, begin=None, end=None) -> DataFrame:
    """Filter by campaign (name pattern or id), event names and dates (inclusive)."""
    if name_pattern is not None:
        events = events.filter(name_like("canvas_name", name_pattern))
    if canvas_id is not None:
        events = events.filter(F.col("canvas_id") == F.lit(canvas_id))
    if kinds is not None:
        events = events.filter(F.col("event_name").isin(list(kinds)))
    if begin is not None:
        events = events.filter(F.col("dt") >= F.lit(begin))
    if end is not None:
        events = events.filter(F.col("dt") <= F.lit(end))
    return events


def first_date(condition: Column) -> Column:
    return F.min(F.when(condition, F.col("dt")))


def entry_date() -> Column:
    return first_date(F.col("event_name") == ENTRY).alias("canvas_entry_date")


def offer_counts(sizes) -> list[Column]:
    """How many events showed each offer, read from the step name."""
    return [
        F.count_if(F.col("canvas_step_name").like(f"%{size}%")).alias(f"num_offers_{size}")
        for size in sizes
    ]


def dropout_rollup(events: DataFrame, begin=None, end=None, *,
                   name_pattern: str | None = DROPOUT_NAMES, canvas_id=None,
                   entered_since=None) -> DataFrame:
    """Per (user, variation): first entry date and offers seen by size."""
    chosen = choose_events(
        events, name_pattern=None if canvas_id is not None else name_pattern,
        canvas_id=canvas_id, kinds=ENTRY_OR_DELIVERY, begin=begin, end=end)
    rolled = chosen.groupBy("external_user_id", "canvas_variation_name").agg(
        entry_date(), *offer_counts((20, 30, 40)))
    if entered_since is not None:
        rolled = rolled.filter(F.col("canvas_entry_date") >= F.lit(entered_since))
    return rolled


def _winback_measures() -> list[Column]:
    kind, variation = F.col("event_name"), F.col("canvas_variation_name")
    return [
        first_date(kind == DELIVERY).alias("first_email_date"),
        entry_date(),
        # The day the test starts: entry for control, first email for the rest.
        first_date(((variation == CONTROL) & (kind == ENTRY))
                   | ((variation != CONTROL) & (kind == DELIVERY))).alias("test_date"),
        *offer_counts((10, 20, 30, 40)),
    ]


def winback_rollup(events: DataFrame, entered_since) -> DataFrame:
    """Per (user, variation) over win-back campaigns, entries since a date."""
    chosen = choose_events(events, name_pattern=WINBACK_NAMES, kinds=ENTRY_OR_DELIVERY)
    return (
        chosen.groupBy("external_user_id", "canvas_variation_name")
        .agg(*_winback_measures())
        .filter(F.col("canvas_entry_date") >= F.lit(entered_since))
    )


def winback_group_rollup(events: DataFrame) -> DataFrame:
    """Per (user, control or treatment): users with an offer, and all controls."""
    chosen = choose_events(events, name_pattern=WINBACK_EMAIL_NAMES, kinds=ENTRY_OR_DELIVERY)
    group = F.when(F.col("canvas_variation_name") == CONTROL, "control").otherwise("treatment")
    offers = [f"num_offers_{size}" for size in (10, 20, 30, 40)]
    seen = sum((F.col(name) for name in offers[1:]), F.col(offers[0]))
    return (
        chosen.groupBy("external_user_id", group.alias("experiment_group"))
        .agg(*_winback_measures())
        .filter((seen > 0) | (F.col("experiment_group") == "control"))
    )


def users_per_variation(rollup: DataFrame) -> DataFrame:
    return rollup.groupBy("canvas_variation_name").count().orderBy("canvas_variation_name")
