"""Exact duplicates by progressive refinement: length, prefix hash, full hash.

The first pass reads of each text only its length and the hash of its start,
and counts these pairs. Only rows that share both with another row reach the
full hash. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlift.llm.shared import stored, text_of

WHITE_SPACE = r"[\x20\x09-\x0D]+"
PREFIX = 256


def normalised(column: str = "text") -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(text_of(column), WHITE_SPACE, "")


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                     prefix: int = PREFIX, hash_all: bool = False) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, full_hash.

    Texts are equal when they are identical without white space. Of equal
    texts the longest original stays, then the smallest id.

    full_hash is the SHA-256 of the text without white space for every row
    that reached the last level, and null for the others; ``hash_all`` asks
    for it everywhere, which changes no group.

    Null text counts as empty, and empty texts equal each other. A null id
    sorts after all ids. Rows repeated with the same id count in group_size
    and share the verdict. An empty table gives an empty result. Other
    columns are not read, whatever their names.

    No group is ever gathered: groups are counts and minima, combined before
    the shuffle, and the joins are plain equality joins whose hot keys
    adaptive execution splits.
    """
    rows = docs.select(
        F.col(id_column).alias("_id"),
        F.length(text_of(text_column)).alias("_chars"),
        normalised(text_column).alias("_norm"),
    ).withColumns({
        "_len": F.length("_norm"),
        "_prefix": F.xxhash64(F.substring("_norm", 1, prefix)),
    })

    pairs = stored(rows.groupBy("_len", "_prefix").agg(F.count("*").alias("_n")))
    crowded = pairs.groupBy("_len").agg(F.sum("_n").alias("_all")).filter("_all > 1")
    candidates = stored(
        pairs.filter("_n > 1").join(crowded, "_len", "left_semi")
        .select("_len", "_prefix", F.lit(True).alias("_shared")))

    full = F.sha2(F.col("_norm").cast("binary"), 256)
    wanted = F.lit(True) if hash_all else F.col("_shared").isNotNull()
    hashed = stored(
        rows.join(candidates, ["_len", "_prefix"], "left")
        .select("_id", "_chars", F.col("_shared").isNotNull().alias("_shared"),
                F.when(wanted, full).alias("_hash")))

    best = F.struct((-F.col("_chars")).alias("a"), F.col("_id").isNull().alias("b"),
                    F.col("_id").alias("c"))
    groups = stored(
        hashed.filter("_shared").groupBy("_hash")
        .agg(F.count("*").alias("_size"), F.min(best).alias("_best"))
        .filter("_size > 1")
        .select(F.col("_hash").alias("_group"), "_size",
                F.col("_best.c").alias("_keep"), (-F.col("_best.a")).alias("_most")))
    joined = hashed.join(groups, F.col("_shared") & (F.col("_hash") == F.col("_group")), "left")
    alone = F.col("_group").isNull()
    stays = F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_chars") == F.col("_most"))
    return joined.select(
        F.col("_id").alias(id_column),
        F.when(alone, F.col("_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_size", F.lit(1).cast("bigint")).alias("group_size"),
        F.when(alone, True).otherwise(stays).alias("kept"),
        F.col("_hash").alias("full_hash"),
    )
