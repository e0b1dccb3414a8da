"""Input tables: declared columns, loading, and the small lookups on them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns each table must have, with the Spark types accepted for them.
# Ids may be strings or integers; nothing depends on which.
ID = ("string", "bigint", "int")
TIME = ("timestamp", "timestamp_ntz")

REQUIRED = {
    "subscriptions": {
        "hs_user_id": ID,
        "subscription_id": ID,
        "dt": ("date",),
        "created_timestamp": TIME,
        "updated_timestamp": TIME,
        "subscription_type": ("string",),
        "country_code": ("string",),
        "free_trial_days": ("int", "bigint"),
        "free_trial_start_date": ("date",),
        "free_trial_end_date": ("date",),
        "paid_subscription_start_date": ("date",),
        "paid_subscription_end_date": ("date",),
        "plan_initial_term_months": ("int", "bigint"),
        "plan_renewal_term_months": ("int", "bigint"),
        "renewal_count": ("int", "bigint"),
        "subscription_platform": ("string",),
        "voucher_code": ("string",),
    },
    "campaign_events": {
        "external_user_id": ID,
        "dt": ("date",),
        "canvas_id": ID,
        "canvas_name": ("string",),
        "canvas_variation_name": ("string",),
        "event_name": ("string",),
        "canvas_step_name": ("string",),
        "in_control_group": ("boolean",),
    },
    "campaigns": {
        "id": ID,
        "name": ("string",),
        "created_at": TIME + ("date",),
        "first_entry": TIME + ("date",),
        "last_entry": TIME + ("date",),
    },
    "engagement_features": {"hs_user_id": ID, "signup_date": ("date",)},
    "event_features": {"hs_user_id": ID, "signup_date": ("date",)},
    "scores": {
        "hs_user_id": ID,
        "signup_date": ("string", "date"),
        "propensity_TR": ("double",),
        "propensity_CR": ("double",),
        "propensity_TN": ("double",),
        "propensity_CN": ("double",),
        "uplift_score": ("double",),
        "uplift_score_bin": ("int",),
    },
}


def check_columns(df: DataFrame, table: str) -> DataFrame:
    """Return ``df`` if it has the columns ``table`` needs, else raise."""
    have = dict(df.dtypes)
    wrong = [
        f"{column}: {have.get(column, 'missing')} (want {' or '.join(types)})"
        for column, types in REQUIRED[table].items()
        if have.get(column) not in types
    ]
    if wrong:
        raise ValueError(f"table {table!r} does not fit: " + "; ".join(wrong))
    return df


def load(spark: SparkSession, table: str, path: str | None = None,
         name: str | None = None) -> DataFrame:
    """Read a declared table from a Parquet folder or by catalog name.

    ``mergeSchema`` is on for scores only: that sink gains columns over time,
    and Parquet merges schemas when reading, not when writing.
    """
    if path is None:
        df = spark.table(name or table)
    else:
        merge = "true" if table == "scores" else "false"
        df = spark.read.option("mergeSchema", merge).parquet(path)
    return check_columns(df, table)


def features_between(features: DataFrame, begin, end) -> DataFrame:
    """Daily features of the users who signed up from begin to end, inclusive."""
    return features.filter(F.col("signup_date").between(F.lit(begin), F.lit(end)))


def latest_date(df: DataFrame, column: str = "signup_date") -> DataFrame:
    """One row: the newest date present."""
    return df.agg(F.max(column).alias(column))


def available_dates(df: DataFrame, column: str = "signup_date") -> DataFrame:
    """Every date present, oldest first."""
    return df.select(column).distinct().orderBy(column)


def user_history(subscriptions: DataFrame, user_ids: Iterable | DataFrame) -> DataFrame:
    """All subscription rows of the given users (a few ids, or a frame of them)."""
    if isinstance(user_ids, DataFrame):
        return subscriptions.join(user_ids.select("hs_user_id"), "hs_user_id", "left_semi")
    return subscriptions.filter(F.col("hs_user_id").isin(list(user_ids)))
