"""Column expressions shared by the plans."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# A missing date counts as this one in comparisons. Never move it upward:
# later dates do not fit Python's date type.
FAR_FUTURE = dt.date(9999, 12, 31)


def or_far_future(date: Column | str) -> Column:
    return F.coalesce(date, F.lit(FAR_FUTURE))


def days_from(start: Column | str, end: Column | str) -> Column:
    """Whole days from start to end, negative if end comes first."""
    return F.datediff(end, start)


def name_like(column: Column | str, pattern: str) -> Column:
    """Case-insensitive LIKE; the pattern is given in lower case."""
    return F.lower(column).like(pattern)


def same_text(column: Column | str, value: str) -> Column:
    """Case-insensitive equality."""
    return F.lower(column) == value.lower()


def month_start(date: Column | str) -> Column:
    return F.trunc(date, "MM")


def voucher_discount(voucher: Column | str) -> Column:
    """Two digits in front of 'off', as an integer; null without them.

    ``try_cast`` because the pattern gives '' when it does not match, and a
    plain cast of '' raises under ANSI mode.
    """
    return F.regexp_extract(F.lower(voucher), "([0-9]{2})off", 1).try_cast("int")


def plan_length(months: Column | str) -> Column:
    months = F.col(months) if isinstance(months, str) else months
    return F.when(months == 1, "monthly").when(months == 12, "annual").otherwise("other")


def subscriber_kind(renewals: Column | str) -> Column:
    renewals = F.col(renewals) if isinstance(renewals, str) else renewals
    return F.when(renewals > 0, "returning").otherwise("new")


def largest_offer(sizes=(40, 30, 20)) -> Column:
    """Biggest discount a user was shown, from the offer counts; else 0."""
    best = F.lit(0)
    for size in sorted(sizes):
        best = F.when(F.col(f"num_offers_{size}") > 0, size).otherwise(best)
    return best


def total_offers(sizes=(10, 20, 30, 40)) -> Column:
    return sum((F.col(f"num_offers_{size}") for size in sizes[1:]),
               F.col(f"num_offers_{sizes[0]}"))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or unknown."""
    return F.when(condition, 1).otherwise(0)


def uplift(tr: Column, cr: Column) -> Column:
    """Response with the offer plus no response without it, less the opposites."""
    return tr + (1 - cr) - (1 - tr) - cr
