"""Writing scores, and handing them out in batches."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlift.operators.numbering import number_rows
from cohortlift.operators.sequences import first_per

# Fixed value: users the receiving service takes in one request.
USERS_PER_REQUEST = 50

# The columns of the stored score table.
SCORE_COLUMNS = [
    "hs_user_id", "signup_date", "propensity_TR", "propensity_CR", "propensity_TN",
    "propensity_CN", "uplift_score", "uplift_score_bin", "run_date",
]


def write_scores(scores: DataFrame, path: str, *, replace_dates: bool = False) -> None:
    """Append scores, one folder per signup date.

    Columns may be added later; readers merge the schemas. With
    ``replace_dates`` the dates in ``scores`` are overwritten and no others, so
    that a date can be run again. Rows of a date are brought together first, so
    that a task does not write a file for every date; large dates are split.
    """
    writer = scores.hint("rebalance", "signup_date").write.partitionBy("signup_date")
    if replace_dates:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode("append").parquet(path)


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def _unlike(field: T.StructField, stored: T.StructField) -> bool:
    return field.dataType.simpleString() != stored.dataType.simpleString()


def _fitted(scores: DataFrame, table: str) -> DataFrame:
    """``scores`` in the columns of ``table``, which gains those it lacks."""
    spark = scores.sparkSession
    stored = {f.name.lower(): f for f in spark.table(table).schema}
    unlike = [f"{f.name}: {f.dataType.simpleString()}, stored {stored[f.name.lower()].dataType.simpleString()}"
              for f in scores.schema if f.name.lower() in stored and _unlike(f, stored[f.name.lower()])]
    if unlike:
        raise ValueError(f"types differ from those of {table}: {'; '.join(unlike)}")
    new = [f for f in scores.schema if f.name.lower() not in stored]
    if new:
        listed = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in new)
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({listed})")
    given = {c.lower() for c in scores.columns}
    # As stored: new columns come last but one, before the one the table is partitioned by.
    return scores.select(*[
        F.col(_quoted(f.name)) if f.name.lower() in given else F.lit(None).cast(f.dataType).alias(f.name)
        for f in spark.table(table).schema])


def append_to_table(scores: DataFrame, table: str, *, replace_dates: bool = False) -> None:
    """Append scores to a table of the catalog, made by the first call; ``load(name=table)`` reads it.

    Columns are matched by name. New ones are added to the table, where rows
    written before read null; ones that ``scores`` lacks are null in its rows.
    A column that changes its type is refused before anything is written. With
    ``replace_dates`` the dates in ``scores`` are overwritten and no others.
    """
    spark = scores.sparkSession
    if not spark.catalog.tableExists(table):
        scores.hint("rebalance", "signup_date").write.partitionBy("signup_date").format(
            "parquet").saveAsTable(table)
        return
    fitted = _fitted(scores, table).hint("rebalance", "signup_date")
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key)
    spark.conf.set(key, "dynamic")      # insertInto has no option for it
    try:
        fitted.write.insertInto(table, overwrite=replace_dates)
    finally:
        spark.conf.set(key, before)


def backfill_table(dates: Iterable[dt.date], job: Callable[[dt.date], DataFrame], table: str) -> None:
    """``backfill`` into a table of the catalog.

    A date for which ``job`` gives no rows has none afterwards.
    """
    for date in dates:
        scores = job(date)
        append_to_table(scores, table, replace_dates=True)
        if scores.isEmpty():
            scores.sparkSession.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (signup_date = '{date}')")


def backfill(dates: Iterable[dt.date], job: Callable[[dt.date], DataFrame], path: str) -> None:
    """Run ``job`` for each date; every run replaces its own date only.

    A date for which ``job`` gives no rows has none afterwards.
    """
    for date in dates:
        scores = job(date)
        system, folder = _date_folder(scores.sparkSession, path, date)
        before = _file_names(system, folder)
        write_scores(scores, path, replace_dates=True)
        # Names of written files are new, so the same ones mean that nothing was written.
        if before and _file_names(system, folder) == before:
            system.delete(folder, True)


def _date_folder(spark: SparkSession, path: str, date: dt.date):
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path, f"signup_date={date}")
    return folder.getFileSystem(context._jsc.hadoopConfiguration()), folder


def _file_names(system, folder) -> set[str]:
    return {f.getPath().getName() for f in system.listStatus(folder)} if system.exists(folder) else set()


def latest_scores(scores: DataFrame, signup_date: str | None = None) -> DataFrame:
    """Each user's newest score, of one signup date if given."""
    if signup_date is not None:
        scores = scores.filter(F.col("signup_date") == F.lit(signup_date))
    newest = [F.desc("signup_date")]
    if "run_date" in scores.columns:
        newest.append(F.desc_nulls_last("run_date"))
    ties = [F.desc("uplift_score"), F.desc("uplift_score_bin")]
    return first_per(scores, "hs_user_id", *newest, *ties).select(
        "hs_user_id", "uplift_score_bin", "uplift_score")


def payload_batches(scores: DataFrame, signup_date: str | None = None,
                    size: int = USERS_PER_REQUEST) -> DataFrame:
    """One row per request: its number and an array of user payloads.

    Users are numbered by id and dealt out by that number, so batches differ by
    one user at most and none is larger than ``size``.
    """
    numbered, users = number_rows(latest_scores(scores, signup_date), "hs_user_id")
    batches = max(1, math.ceil(users / size))
    # The field names that the receiver reads, and the two columns of a batch.
    payload = F.struct(
        F.col("hs_user_id").cast("string").alias("external_id"),
        F.col("uplift_score_bin").cast("int").alias("uplift_score_bin"),
        F.col("uplift_score"),
    )
    return (
        numbered.groupBy((F.col("row_number") % batches).alias("batch_request_num"))
        .agg(F.collect_list(payload).alias("batch_request_payload"))
    )


def export_batches(batches: DataFrame, path: str) -> None:
    """Write one JSON line per request."""
    batches.write.mode("overwrite").json(path)


def deliver(batches: DataFrame, send: Callable[[list[dict]], None]) -> None:
    """Call ``send`` once per batch, on the executors.

    A lost task is run again and sends its batches again; ``send`` must accept
    repeats. Deliver from written batches, so that a retry sees the same ones.
    ``delivery.deliver`` keeps a ledger and sends none of them again.
    """

    def each(rows):
        for row in rows:
            send([user.asDict() for user in row["batch_request_payload"]])

    batches.foreachPartition(each)
