"""Row numbers and running totals over a whole table, without one big task.

A window without a partition key sorts every row in one task. Here the rows
are range-partitioned on the sort order instead, so each partition is one
contiguous chunk of the result; a chunk only needs to know how much came
before it, which is one number per chunk.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = "_chunk"
POSITION = "_position"
# monotonically_increasing_id() keeps the partition above bit 33.
ROW_BITS = 33
# Rows of a few hundred bytes that a task sorts, aggregates and puts in windows.
ROWS_A_TASK = 500_000


def use_checkpoint_folder(spark: SparkSession) -> None:
    """Point checkpoints at the cluster's shared folder.

    Falls back to a temporary folder only when Spark runs on this one machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    context.setCheckpointDir(folder)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back.

    Unlike a checkpoint this also leaves behind what the planner knows of the
    columns: a column made from very many others would be rewritten for every
    subset of them that a later projection renames.
    """
    spark = df.sparkSession
    use_checkpoint_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partition_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks_for(df: DataFrame, rows_each: int = ROWS_A_TASK) -> int:
    """As many tasks as leave each ``rows_each`` rows of ``df``, one per shuffle partition at least.

    Adaptive execution joins partitions by their compressed bytes, which say
    little about what sorting wide rows takes; partitions asked for by number
    it leaves as they are, so a task's memory stays the same as tables grow.
    """
    return max(partition_count(df.sparkSession), -(-df.count() // rows_each))


def in_chunks(df: DataFrame, *order: Column | str, parts: int | None = None) -> DataFrame:
    """Sort ``df`` into range chunks, adding ``_chunk`` and ``_position``.

    Range bounds come from a sample, so a second run could cut elsewhere. The
    checkpoint fixes one cut for everything that follows. ``order`` should be
    unique per row: rows with equal keys all land in one chunk.
    """
    spark = df.sparkSession
    use_checkpoint_folder(spark)
    placed = (
        df.repartitionByRange(parts or partition_count(spark), *order)
        .sortWithinPartitions(*order)
        .withColumn("_row", F.monotonically_increasing_id())
        .checkpoint()
    )
    return placed.select(
        *df.columns,
        F.shiftright("_row", ROW_BITS).cast("int").alias(CHUNK),
        F.col("_row").bitwiseAND((1 << ROW_BITS) - 1).alias(POSITION),
    )


def _chunk_offsets(chunks: DataFrame, sums: dict[str, Column]) -> tuple[DataFrame, dict]:
    """Totals of all earlier chunks, per chunk, and the grand totals.

    Only one row per range partition comes to the driver.
    """
    names = list(sums)
    rows = (
        chunks.groupBy(CHUNK)
        .agg(*[F.sum(value).cast("bigint").alias(name) for name, value in sums.items()])
        .collect()
    )
    running = dict.fromkeys(names, 0)
    offsets = []
    for row in sorted(rows, key=lambda r: r[CHUNK]):
        offsets.append((row[CHUNK], *[running[name] for name in names]))
        for name in names:
            running[name] += row[name] or 0
    schema = T.StructType(
        [T.StructField(CHUNK, T.IntegerType())]
        + [T.StructField(f"_before_{name}", T.LongType()) for name in names]
    )
    return chunks.sparkSession.createDataFrame(offsets, schema), running


def number_rows(df: DataFrame, *order: Column | str,
                name: str = "row_number") -> tuple[DataFrame, int]:
    """Number all rows 1..n in the given order; also returns n."""
    chunks = in_chunks(df, *order)
    offsets, totals = _chunk_offsets(chunks, {"rows": F.lit(1)})
    numbered = (
        chunks.join(F.broadcast(offsets), CHUNK)   # one row per range partition
        .withColumn(name, F.col("_before_rows") + F.col(POSITION) + 1)
        .drop(CHUNK, POSITION, "_before_rows")
    )
    return numbered, totals["rows"]


def running_totals(df: DataFrame, order: list[Column],
                   sums: dict[str, Column]) -> tuple[DataFrame, dict]:
    """Add inclusive running sums of integer columns; also returns the totals.

    Aggregate equal keys before calling, so that ties are one row.
    """
    chunks = in_chunks(df, *order)
    offsets, totals = _chunk_offsets(chunks, sums)
    inside = (
        Window.partitionBy(CHUNK).orderBy(POSITION)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = chunks.join(F.broadcast(offsets), CHUNK)
    for name, value in sums.items():
        summed = summed.withColumn(
            name, F.sum(value).over(inside) + F.col(f"_before_{name}"))
    return summed.drop(CHUNK, POSITION, *[f"_before_{name}" for name in sums]), totals
