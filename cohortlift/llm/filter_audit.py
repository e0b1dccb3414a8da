"""What each filter of a chain does in every order of the chain.

A document is the set of filters it fails, so all orders follow from the counts
per set. A Gray-code walk visits every subset of filters by toggling one filter
at a time; each cell (documents failing the same set) counts its active
failures, and only cells that pass between none and some change the running
survivors. The stored states answer every step of every order by a difference.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlift.llm.shared import stored, text_of

# All orders are listed, and their number is the factorial of this.
MOST_FILTERS = 7

WHITE_SPACE = r"[\x20\x09-\x0D]+"


def states(cells: Iterable[tuple[int, Sequence[int]]], filters: int) -> list[list[int]]:
    """Survivors of every subset of filters, by the subset's mask.

    ``cells`` holds (mask of failed filters, weights), once per mask. One sum
    per weight; state 0 is everything.
    """
    cells = [(mask, list(weights)) for mask, weights in cells]
    width = max((len(w) for _, w in cells), default=0)
    alive = [sum(w[k] for _, w in cells) for k in range(width)]
    active = [0] * len(cells)
    found: list[list[int]] = [[]] * (1 << filters)
    found[0] = list(alive)
    walk = 0
    for turn in range(1, 1 << filters):
        bit = turn & -turn
        walk ^= bit
        step = 1 if walk & bit else -1
        for k, (mask, weights) in enumerate(cells):
            if mask & bit:
                before, active[k] = active[k], active[k] + step
                if not before or not active[k]:     # it left the survivors, or came back
                    alive = [a - step * w for a, w in zip(alive, weights)]
        found[walk] = list(alive)
    return found


def steps(found: list[list[int]], filters: int) -> Iterator[tuple]:
    """(order, step, kept, removed, redundant, unique fails, losses, shapley) of every step of every order."""
    every = (1 << filters) - 1
    removed_alone = [found[0][0] - found[1 << f][0] for f in range(filters)]
    unique = [found[every ^ (1 << f)][0] - found[every][0] for f in range(filters)]
    shapley = [
        sum(factorial(s.bit_count()) * factorial(filters - 1 - s.bit_count()) * (found[s][0] - found[s | 1 << f][0])
            for s in range(1 << filters) if not s >> f & 1)
        for f in range(filters)]
    for order in permutations(range(filters)):
        before = 0
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            gone = [a - b for a, b in zip(found[before], found[after])]
            yield (order, step, found[after][0], gone[0], removed_alone[f] - gone[0], unique[f], gone[1:], shapley[f])
            before = after


def audit(flags: DataFrame, filters: Sequence[str], part: str = "part",
          losses: Sequence[str] = ()) -> DataFrame:
    """One row per part, order of the filters and step of the order.

    ``flags`` has one row per document: ``part``, a boolean column per filter
    (true: the document fails it) and one per kind of loss (true: a document
    whose removal counts). Null counts as false. Columns: part, filter_order
    (the names in order, joined by commas if any has several letters), step
    (from 1), kept (after the step), removed (by it), redundant (failing its
    filter, removed earlier), unique_fails (failing its filter alone),
    ``<loss>_lost`` for each kind, shapley (removed by the step's filter, summed
    over all orders, wherever it stands).

    A null part is a part of its own. Rows count as often as they occur. An
    empty table has no parts and gives no rows; parts without failures give
    zeros. Up to seven filters.

    Counting combines before the shuffle, so a part may hold any share of the
    rows; what one task then holds of a part are at most two to the number of
    filters cells.
    """
    if not 1 <= len(filters) <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters, not {len(filters)}")
    mask = sum((F.when(F.col(name), 1 << k).otherwise(0) for k, name in enumerate(filters)), F.lit(0))
    weights = ["n", *(f"w{k}" for k in range(len(losses)))]
    cells = flags.groupBy(F.col(part).alias("part"), mask.alias("mask")).agg(
        F.count("*").alias("n"),
        *[F.count(F.when(F.col(name), 1)).alias(w) for name, w in zip(losses, weights[1:])])
    parts = cells.groupBy("part").agg(
        F.collect_list(F.struct("mask", F.array(*weights).alias("weights"))).alias("cells"))

    long = T.LongType()
    schema = T.StructType([
        T.StructField("part", flags.schema[part].dataType), T.StructField("filter_order", T.StringType()),
        T.StructField("step", T.IntegerType()),
        *(T.StructField(c, long) for c in ("kept", "removed", "redundant", "unique_fails")),
        *(T.StructField(f"{name}_lost", long) for name in losses), T.StructField("shapley", long)])
    comma = "," if any(len(name) > 1 for name in filters) else ""
    names, count, kinds = list(filters), len(filters), len(losses)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, found in zip(batch.column("part"), batch.column("cells").to_pylist()):
                done = states([(c["mask"], c["weights"]) for c in found], count)
                rows = list(steps(done, count))
                columns = list(zip(*rows))
                lost = [[r[6][k] for r in rows] for k in range(kinds)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([own.as_py()] * len(rows), own.type),
                    pa.array([comma.join(names[f] for f in order) for order in columns[0]]),
                    pa.array(columns[1], pa.int32()),
                    *(pa.array(c, pa.int64()) for c in (*columns[2:6], *lost, columns[7])),
                ], names=schema.names)

    return parts.mapInArrow(walked, schema)


def _text_failures(text: Column) -> dict[str, Column]:
    words = F.array_remove(F.split(text, WHITE_SPACE), "")
    distinct = F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * distinct < 50 * F.size(words),
        "C": 100 * capitals > 3 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def document_flags(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id",
                   text_column: str = "text", part_column: str = "lang") -> DataFrame:
    """part, A to E, good, toxic per document: what ``audit`` needs.

    A: under 200 words; B: under half of the words distinct; C: over 3 % capitals
    A-Z; D: holds any of ``#$%&*|``; E: the same text stands under a smaller id.
    Words are separated by space and the characters 9 to 13, case-sensitive.

    Null text counts as empty, a null part as the empty string. A row without
    an id has no smaller id and is none: it neither fails E nor makes another
    row fail it. Rows repeated with one id do not make each other fail. Several
    labels of one id count as 1 if any is 1. Texts count as the same by their
    SHA-256. Other columns are not read.

    Texts are read once and leave as four flags and a digest. Groups of equal
    texts are counts and minima, combined before the shuffle; joins are
    equality joins whose hot keys adaptive execution splits.
    """
    text = text_of(text_column)
    rows = stored(docs.select(
        F.col(id_column).alias("_id"), F.coalesce(F.col(part_column), F.lit("")).alias("part"),
        *[c.alias(name) for name, c in _text_failures(text).items()],
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("_hash")))
    first = rows.groupBy("_hash").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    marks = labels.groupBy(F.col(id_column).alias("_id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return (
        rows.join(first.select("_hash", "_first"), "_hash", "left").join(marks, "_id", "left")
        .select("part", "A", "B", "C", "D", (F.col("_first") < F.col("_id")).alias("E"), "good", "toxic"))
