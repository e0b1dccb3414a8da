"""From raw documents to packed training sequences.

Each stage works on all that the one before it kept, written as Parquet and
read again in between: documents that the quality classifier rejects go,
later repeats of passages are cut out, one document of each near-duplicate
class stays, documents that hold benchmark items go, and what is left is
packed into sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlift.llm import decontamination, line_dedup, packing, quality, simhash
from cohortlift.llm.queries import table, tokenizer_path
from cohortlift.llm.shared import ship, stored


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the classifier rejects."""
    ship(spark)
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut later repeats of passages; a document that was nothing else goes."""
    ship(spark)
    return line_dedup.deduplicated(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each class of fingerprints: four-word shingles, at most four bits apart."""
    ship(spark)
    return simhash.first_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    ship(spark)
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, as ids and as their digest."""
    ship(spark)
    pieces = packing.packed(docs, tokenizer_path())
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", accept_quality),
    ("line_dedup", cut_repeats),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# The classifier, the fingerprints and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder: one row per piece of a packed sequence.

    Null texts count as empty. Rows with a null id are never dropped by the
    classifier or as near duplicates, since nothing tells them apart. Rows that
    repeat an id share every verdict. A document that is cut down to nothing
    goes. An empty table gives no pieces. Columns beside id and text are
    carried along unread.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
