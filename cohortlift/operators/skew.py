"""Finding users that hold very many rows, and joining without piling them up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlift.operators.numbering import partition_count, stored

# A user below this many rows is no burden for one task.
HEAVY_ROWS = 1_000_000
# Heavy keys are broadcast up to this many; a table needs 10**12 rows to have more.
MOST_BROADCAST = 1_000_000

SALT = "_salt"
HEAVY = "_heavy"

# No heavy keys, a few known ones, or a frame with one column of them.
Heavy = DataFrame | list | tuple


def heavy_keys(df: DataFrame, key: str, at_least: int = HEAVY_ROWS) -> Heavy:
    """All keys with ``at_least`` rows or more: a stored frame, or ``[]`` if there are none.

    The counts are combined before the shuffle, so a heavy key costs nothing
    extra here. The keys stay in the checkpoint folder; none comes to the driver.
    """
    counted = df.filter(F.col(key).isNotNull()).groupBy(key).count()
    found = stored(counted.filter(F.col("count") >= at_least).select(key))
    return [] if found.isEmpty() else found


def any_heavy(heavy: Heavy) -> bool:
    return isinstance(heavy, DataFrame) or len(heavy) > 0


def mark_heavy(df: DataFrame, key: str, heavy: Heavy) -> DataFrame:
    """Add ``_heavy``: true for heavy keys, false for the rest, nulls included.

    Too many heavy keys to broadcast are joined by shuffle, where Spark splits
    the pieces of the largest.
    """
    if not isinstance(heavy, DataFrame):
        return df.withColumn(HEAVY, F.coalesce(F.col(key).isin(list(heavy)), F.lit(False)))
    marks = heavy.toDF(key).distinct().withColumn(HEAVY, F.lit(True))
    return df.join(broadcast_checked(marks, MOST_BROADCAST), key, "left").select(
        *df.columns, F.coalesce(HEAVY, F.lit(False)).alias(HEAVY))


def join_spread(many: DataFrame, few: DataFrame, key: str, deal_on: str,
                heavy: Heavy) -> DataFrame:
    """Inner join on ``key`` with the rows of heavy keys dealt over all tasks.

    ``many`` may hold a large share of its rows under one key: those rows are
    dealt by a hash of ``deal_on``. The matching rows of ``few``, which must be
    a roll-up with few rows per key, are repeated for every hand.
    """
    if not any_heavy(heavy):
        return many.join(few, key)
    hands = partition_count(many.sparkSession)
    dealt = mark_heavy(many, key, heavy).withColumn(
        SALT,
        F.when(F.col(HEAVY), F.pmod(F.xxhash64(deal_on), F.lit(hands)))
        .otherwise(F.lit(0).cast("bigint")),
    ).drop(HEAVY)
    repeated = mark_heavy(few, key, heavy).withColumn(
        SALT,
        F.explode(
            F.when(F.col(HEAVY),
                   F.sequence(F.lit(0).cast("bigint"), F.lit(hands - 1).cast("bigint")))
            .otherwise(F.array(F.lit(0).cast("bigint")))
        ),
    ).drop(HEAVY)
    return dealt.join(repeated, [key, SALT]).drop(SALT)


def broadcast_checked(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """Mark ``df`` for broadcast if it has few rows; else leave it to Spark.

    A plain count, since a limit would gather rows of a large table in one task.
    """
    return df if df.count() > most_rows else F.broadcast(df)
