"""Feature tables stored so that joins on their keys need no shuffle.

A frame joins each feature table on (user, signup date). Cut into buckets by
these keys when written, a table is read bucket by bucket, already in place:
only the users are shuffled, once, for all tables with the same number of
buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURE_KEYS = ("hs_user_id", "signup_date")


def write_bucketed(df: DataFrame, table: str, buckets: int, keys: tuple[str, ...] = FEATURE_KEYS, *,
                   path: str | None = None, append: bool = False) -> None:
    """Store ``df`` as a catalog table cut into ``buckets`` by ``keys``, sorted inside.

    Rows are brought to their bucket first, so a bucket is one file a call and
    not one file per task. Give all tables that are joined the same number of
    buckets; at about 500 MB each a task holds one of every table. ``keys`` must
    nearly be unique: rows with equal keys share a bucket. Null keys share one,
    too. ``append`` adds rows to a table made earlier, whose buckets then hold
    one file per call; a table cut otherwise is refused. ``path`` puts the
    files outside the warehouse. An empty ``df`` makes an empty table.
    """
    if append:
        found = bucketing(df.sparkSession, table)
        if found != (buckets, list(keys)):
            raise ValueError(f"{table} is cut by {found}, not by {(buckets, list(keys))}")
        # Rows go in by place, so they are put in the order of the table.
        df = df.select(*df.sparkSession.table(table).columns)
    writer = (
        df.repartition(buckets, *keys).write.format("parquet")
        .bucketBy(buckets, *keys).sortBy(*keys).mode("append" if append else "errorifexists"))
    (writer.option("path", path) if path else writer).saveAsTable(table)


def bucketing(spark: SparkSession, table: str) -> tuple[int, list[str]] | None:
    """How many buckets a catalog table has and by which columns; None if it has none."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").filter(
        F.col("col_name").isin("Num Buckets", "Bucket Columns")).collect()
    about = {row["col_name"]: row["data_type"] for row in rows}
    if "Num Buckets" not in about:
        return None
    return int(about["Num Buckets"]), [c.strip(" `") for c in about["Bucket Columns"].strip("[]").split(",")]
