"""Date windows of a scoring run."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

# Fixed lengths of the windows, in days.
HORIZON_DAYS = 42
TEST_DAYS = 28
TRAIN_DAYS = 365
JOB_LAG_DAYS = 7


@dataclass(frozen=True)
class Windows:
    train_begin: dt.date
    train_end: dt.date
    test_begin: dt.date
    test_end: dt.date


def windows_for(scoring_date: dt.date, horizon: int = HORIZON_DAYS) -> Windows:
    """Train and test ranges, both old enough for outcomes to be known."""
    back = lambda days: scoring_date - dt.timedelta(days=horizon + days)
    return Windows(
        train_begin=back(TEST_DAYS + 1 + TRAIN_DAYS),
        train_end=back(TEST_DAYS + 1),
        test_begin=back(TEST_DAYS),
        test_end=back(1),
    )


def default_scoring_date(today: dt.date) -> dt.date:
    return today - dt.timedelta(days=JOB_LAG_DAYS)


def dates_back(last: dt.date, count: int) -> list[dt.date]:
    """``count`` days ending at ``last``, newest first."""
    return [last - dt.timedelta(days=back) for back in range(count)]
