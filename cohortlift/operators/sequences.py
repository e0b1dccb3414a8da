"""Ordering each user's rows: next values, ordinals, nearest match.

Windows keyed by user put all rows of a user in one task. Users known to be
heavy take another way with the same result: their rows are cut into range
chunks of the same order, the windows run inside chunks, and what crosses a
chunk border is filled in from a table with one row per (user, chunk).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlift.operators.numbering import CHUNK, POSITION, in_chunks
from cohortlift.operators.skew import HEAVY, Heavy, any_heavy, broadcast_checked, mark_heavy

# Subscriptions in the order they were taken out; the id settles ties.
BY_START = ["dt", "created_timestamp", "updated_timestamp", "subscription_id"]
BY_DATE = ["dt", "subscription_id"]
BY_PAID_START = ["paid_subscription_start_date", "subscription_id"]


def _ascending(order: list[str]) -> list[Column]:
    return [F.col(column).asc_nulls_first() for column in order]


def _split_heavy(df: DataFrame, key: str, heavy: Heavy, plain, chunked) -> DataFrame:
    if not any_heavy(heavy):
        return plain(df)
    marked = mark_heavy(df, key, heavy)
    part = lambda condition: marked.filter(condition).drop(HEAVY)
    return plain(part(~F.col(HEAVY))).unionByName(chunked(part(F.col(HEAVY))))


def with_next(df: DataFrame, key: str, order: list[str], nexts: dict[str, str],
              default=None, heavy: Heavy = ()) -> DataFrame:
    """Add columns taken from the user's following row.

    ``nexts`` maps new column to source column. ``default`` stands in where
    there is no following row; a null in an existing row stays null.
    """

    def plain(rows: DataFrame) -> DataFrame:
        window = Window.partitionBy(key).orderBy(*_ascending(order))
        return rows.select("*", *[
            F.lead(source, 1, default).over(window).alias(name)
            for name, source in nexts.items()
        ])

    def chunked(rows: DataFrame) -> DataFrame:
        chunks = in_chunks(rows, F.col(key), *_ascending(order))
        values = F.struct(*[F.col(source).alias(name) for name, source in nexts.items()])
        # One row per (user, chunk): chunks are contiguous, so there are at
        # most as many of these as range partitions plus heavy users.
        heads = chunks.groupBy(key, CHUNK).agg(F.min_by(values, POSITION).alias("_head"))
        across = Window.partitionBy(key).orderBy(CHUNK)
        heads = heads.select(key, CHUNK, F.lead("_head").over(across).alias("_border"))
        inside = Window.partitionBy(key, CHUNK).orderBy(POSITION)
        filled = (
            chunks.withColumn("_following", F.lead(values).over(inside))
            .join(broadcast_checked(heads), [key, CHUNK])
            .withColumn("_following", F.coalesce("_following", "_border"))
        )
        return filled.select(*df.columns, *[
            F.when(F.col("_following").isNotNull(), F.col(f"_following.{name}"))
            .otherwise(F.lit(default)).alias(name)
            for name in nexts
        ])

    return _split_heavy(df, key, heavy, plain, chunked)


def with_ordinal(df: DataFrame, key: str, order: list[str], name: str = "sub_rank",
                 heavy: Heavy = ()) -> DataFrame:
    """Number each user's rows 1, 2, ... in the given order."""

    def plain(rows: DataFrame) -> DataFrame:
        window = Window.partitionBy(key).orderBy(*_ascending(order))
        return rows.withColumn(name, F.row_number().over(window).cast("bigint"))

    def chunked(rows: DataFrame) -> DataFrame:
        chunks = in_chunks(rows, F.col(key), *_ascending(order))
        earlier = (
            Window.partitionBy(key).orderBy(CHUNK)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        counts = (
            chunks.groupBy(key, CHUNK).agg(F.count("*").alias("_rows"))
            .select(key, CHUNK, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
        )
        inside = Window.partitionBy(key, CHUNK).orderBy(POSITION)
        return (
            chunks.withColumn("_inside", F.row_number().over(inside))
            .join(broadcast_checked(counts), [key, CHUNK])   # as many rows as above
            .select(*df.columns, (F.col("_before") + F.col("_inside")).cast("bigint").alias(name))
        )

    return _split_heavy(df, key, heavy, plain, chunked)


def first_per(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """Keep each user's first row in the given order.

    The filter sits right on the rank, so Spark keeps one candidate per user
    in every task before it shuffles; a heavy user needs no special care.
    """
    window = Window.partitionBy(key).orderBy(*order)
    return (
        df.withColumn("_rank", F.row_number().over(window))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )
