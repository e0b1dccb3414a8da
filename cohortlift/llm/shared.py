"""Stored intermediate tables, files in the shared folder, and small helpers.

Everything that one job writes and another reads goes to the folder named in
``spark.checkpoint.dir``, which driver and executors share.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_AT_ONCE = 1 << 20   # bytes

_local_folder: list[str] = []
_made: list[tuple[SparkSession, str]] = []
_shipped: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Where that is unset and Spark runs on this one machine, as in tests, a
    temporary folder stands in. It is emptied when Python ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        if not _local_folder:
            _local_folder.append(tempfile.mkdtemp(prefix="llm-"))
        base = _local_folder[0]
    path = f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder made here. Results that read it end with it."""
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: its folder goes with the cluster's own clean-up
        pass


def release() -> None:
    """Delete every folder made so far. Results that read them end with it."""
    while _made:
        delete(*_made.pop())


atexit.register(release)


def stored_at(df: DataFrame, codec: str = "zstd") -> tuple[DataFrame, str]:
    """``stored``, and the folder, for tables that ``delete`` is to end early."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and return the table that reads it.

    Cuts the lineage: what follows survives the loss of any executor, and
    rows that are read several times are computed once.
    """
    return stored_at(df, codec)[0]


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="code-")) / "cohortlift_code.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def text_of(column: str = "text") -> Column:
    """The text, with null counted as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def portions(batches: Iterator[pa.RecordBatch], column: str, most: int = TEXT_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The same rows, in order, in batches of at most ``most`` bytes of text, or of one row.

    A batch of Spark's has 10,000 rows, whatever their length; as Python
    strings all at once they would take several times its memory.
    """
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start, before = 0, 0
        while start < len(ends):
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start, before = stop, int(ends[stop - 1])


def row_key(*columns: str) -> Column:
    """A 128-bit key of a row's content, as a string.

    Rows alike in these columns share it, whatever the ids hold: doc_id may be
    null or occur twice.
    """
    joined = F.concat_ws("\x1f", *[
        F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in columns])
    return F.md5(joined)


def shards_for(spark: SparkSession, total: int, each: int) -> int:
    """As many partitions as hold ``each`` units of ``total``, one per core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-total // each))
