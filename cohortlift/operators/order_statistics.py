"""Exact order statistics of several columns at once.

All columns are searched together, in rounds. A round narrows the bracket of
every rank: mergeable sketches propose narrower ones, and a counting pass over
the old brackets tells exactly where each rank lies. A sketch that is wrong
costs a further round, never a wrong value. A bracket that holds few distinct
values is settled by counting these. No task and no answer to the driver grows
with the table: both are bounded by the number of ranks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

# A sketch is off by one in so many of the values it has seen.
ACCURACY = 2000
# A bracket with at most so many distinct values is settled by counting them.
LISTED = 50_000


@dataclass
class Bracket:
    """Values of a column from ``low`` to ``high``, both present, and the ranks sought there."""

    column: int
    low: float
    high: float
    before: int     # rows of the column below ``low``
    rows: int       # rows inside
    distinct: int   # distinct values inside, about
    ranks: list[int]

    @property
    def listable(self) -> bool:
        # The estimate is within a tenth for all but one in thousands.
        return self.rows <= LISTED or self.distinct <= 0.9 * LISTED


def _measures() -> list[Column]:
    return [F.count("*").alias("rows"), F.min("v").alias("low"), F.max("v").alias("high"),
            F.approx_count_distinct("v").alias("distinct")]


def _stacked(values: DataFrame, width: int) -> DataFrame:
    """One row per column index ``c`` and value ``v``; nulls and not-a-numbers go."""
    pairs = F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"v{i}").alias("v")) for i in range(width)])
    return values.select(F.inline(pairs)).filter(F.col("v").isNotNull() & ~F.isnan("v"))


def _inside(stacked: DataFrame, brackets: list[Bracket]) -> DataFrame:
    """Rows in one of the brackets, with its place ``b`` in the list."""
    place = F.lit(None).cast("int")
    for index, bracket in enumerate(brackets):
        place = F.when(
            (F.col("c") == bracket.column) & F.col("v").between(bracket.low, bracket.high), index
        ).otherwise(place)
    return stacked.withColumn("b", place).filter(F.col("b").isNotNull())


def _proposed(rows: DataFrame, brackets: list[Bracket]) -> list[list[tuple[float, float]]]:
    """Narrower intervals per bracket that should hold its ranks."""
    def around(bracket: Bracket, rank: int) -> list[float]:
        pad = 2 * bracket.rows / ACCURACY + 2
        return [min(1.0, max(0.0, (rank - bracket.before + side * pad) / bracket.rows)) for side in (-1, 1)]

    shares = sorted({s for bracket in brackets for rank in bracket.ranks for s in around(bracket, rank)})
    sketched = rows.groupBy("b").agg(F.percentile_approx("v", shares, ACCURACY).alias("at")).collect()
    at = {row["b"]: dict(zip(shares, row["at"])) for row in sketched}
    return [
        [tuple(at[index][share] for share in around(bracket, rank)) for rank in bracket.ranks]
        for index, bracket in enumerate(brackets)]


def _merged(intervals: list[tuple[float, float]]) -> list[tuple[float, float]]:
    merged: list[tuple[float, float]] = []
    for low, high in sorted(intervals):
        if merged and low <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged


def _narrowed(stacked: DataFrame, brackets: list[Bracket]) -> list[Bracket]:
    """The parts of the brackets in which their ranks lie, counted exactly.

    An interval's two ends are parts of their own, so every round takes at
    least these values out, however often they occur.
    """
    rows = _inside(stacked, brackets)
    cell = F.lit(0)
    for index, intervals in enumerate(_proposed(rows, brackets)):
        passed = F.lit(0)
        for edge in sorted({edge for interval in _merged(intervals) for edge in interval}):
            passed = passed + (F.col("v") >= edge).cast("int") + (F.col("v") > edge).cast("int")
        cell = F.when(F.col("b") == index, passed).otherwise(cell)
    counted = rows.groupBy("b", cell.alias("cell")).agg(*_measures()).collect()
    parts = []
    for index, bracket in enumerate(brackets):
        before = bracket.before
        for row in sorted((r for r in counted if r["b"] == index), key=lambda r: r["cell"]):
            ranks = [rank for rank in bracket.ranks if before <= rank < before + row["rows"]]
            if ranks:
                parts.append(Bracket(bracket.column, row["low"], row["high"], before,
                                     row["rows"], row["distinct"], ranks))
            before += row["rows"]
    return parts


def _listed(stacked: DataFrame, brackets: list[Bracket]) -> dict[tuple[int, int], float]:
    """(column, rank) to value, from the distinct values of small brackets."""
    upto = (
        Window.partitionBy("b").orderBy("v")     # LISTED rows a bracket
        .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    running = (
        _inside(stacked, brackets).groupBy("b", "v").count()
        .withColumn("upto", F.sum("count").over(upto)))
    wanted = [(index, bracket, rank) for index, bracket in enumerate(brackets) for rank in bracket.ranks]
    row = running.agg(*[
        F.min(F.when((F.col("b") == index) & (F.col("upto") > rank - bracket.before), F.col("v"))).alias(str(k))
        for k, (index, bracket, rank) in enumerate(wanted)]).first()
    return {(bracket.column, rank): row[str(k)] for k, (_, bracket, rank) in enumerate(wanted)}


def order_statistics(df: DataFrame, columns: list[str],
                     ranks_of: Callable[[int], list[int]]) -> list[tuple[int, dict[int, float]]]:
    """For each column its number of values, and the values at zero-based ranks.

    ``ranks_of`` gives the ranks sought among so many values. Nulls and
    not-a-numbers are no values; a column without any gives ``(0, {})``.
    """
    values = df.select(*[
        F.col(column).cast("double").alias(f"v{i}") for i, column in enumerate(columns)
    ]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        stacked = _stacked(values, len(columns))
        sizes = {row["c"]: row for row in stacked.groupBy("c").agg(*_measures()).collect()}
        brackets = [
            Bracket(c, row["low"], row["high"], 0, row["rows"], row["distinct"], sorted(set(ranks_of(row["rows"]))))
            for c, row in sorted(sizes.items())]
        found: dict[tuple[int, int], float] = {}
        small: list[Bracket] = []
        while brackets:
            found |= {(b.column, rank): b.low for b in brackets if b.low == b.high for rank in b.ranks}
            small += [b for b in brackets if b.low < b.high and b.listable]
            brackets = [b for b in brackets if b.low < b.high and not b.listable]
            if brackets:
                brackets = _narrowed(stacked, brackets)
        if small:
            found |= _listed(stacked, small)
    finally:
        values.unpersist()
    return [
        (sizes[c]["rows"] if c in sizes else 0, {rank: v for (column, rank), v in found.items() if column == c})
        for c in range(len(columns))]
