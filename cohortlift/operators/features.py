"""Weekly features from ``day{k}_{name}`` columns, all in one projection."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed small number that keeps the slope from dividing by zero.
EPSILON = 0.00000001

# Fixed column names and name parts that make up the model's features.
CATEGORIES = ["plan_renewal_term_months_c", "subscription_platform", "renewal_c"]
FEATURE_PARTS = ["week1", "free_trial_days", "max_discount", "renewal_count"]


def daily_names(df: DataFrame) -> list[str]:
    """Features with a day-0 column; distinct counts do not add up over days."""
    return [c[len("day0_"):] for c in df.columns if "day0" in c and "distinct" not in c]


def _total(columns: list[Column]) -> Column:
    return reduce(add, columns)


def week_sum(name: str, week: int = 1) -> Column:
    days = range(week * 7 - 7, week * 7)
    return _total([F.col(f"day{day}_{name}") for day in days]).alias(f"week{week}_{name}")


def with_week_sums(df: DataFrame, week: int = 1) -> DataFrame:
    return df.select("*", *[week_sum(name, week) for name in daily_names(df)])


def trailing_average(name: str, day: int) -> Column:
    """Mean of the three days ending at ``day``."""
    return (_total([F.col(f"day{d}_{name}") for d in (day, day - 1, day - 2)]) / 3).alias(
        f"day{day}_trailing3day_avg_{name}")


def weeks_2_to_4(name: str) -> Column:
    return _total([F.col(f"week{week}_{name}") for week in (2, 3, 4)]).alias(f"week_2to4_{name}")


def week1_slope(name: str) -> Column:
    """Mean relative change of the trailing averages from day 3 to day 7."""
    average = lambda day: trailing_average(name, day)
    changes = [average(day) / (average(day - 1) + EPSILON) - 1 for day in (7, 6, 5, 4)]
    return (_total(changes) / 4).alias(f"week1_{name}_slope")


def feature_columns(columns: list[str]) -> list[str]:
    """The model's columns, sorted: categories and names with a chosen part."""
    chosen = [c for c in columns if any(part in c for part in FEATURE_PARTS)]
    return sorted(set(CATEGORIES + chosen))


def fill_missing(df: DataFrame) -> DataFrame:
    """Numbers become 0 and missing categories '0'; dates stay null."""
    present = [c for c in CATEGORIES if c in df.columns]
    return df.fillna(0).fillna("0", subset=present)


def eight_day_starts(per_day: str = "content_starts") -> Column:
    """Sum of days 0..7 with missing days as 0, so 0 for an unmatched row."""
    return _total([F.coalesce(F.col(f"day{day}_{per_day}"), F.lit(0)) for day in range(8)])
