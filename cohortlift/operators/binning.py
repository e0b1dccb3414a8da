"""Quantile and equal-width bins, histograms and box summaries.

Bins are closed on the right and the lowest value belongs to the first bin.
Edges are computed exactly; neither ``ntile`` (splits ties) nor
``QuantileDiscretizer`` (approximate, closed on the left) gives these bins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlift.operators.numbering import CHUNK, POSITION, in_chunks
from cohortlift.operators.order_statistics import order_statistics

# Grid points that values are dealt to before their density is taken.
DENSITY_CELLS = 65_536


# ---- quantile edges --------------------------------------------------------

def quantile_ranks(rows: int, q: int) -> list[tuple[int, float]]:
    """Zero-based rank and the part of the way to the next, for k/q, k = 0..q."""
    return [((rows - 1) * k // q, ((rows - 1) * k % q) / q) for k in range(q + 1)]


def interpolate(low: float, high: float, part: float) -> float:
    return float(low) if part == 0 else low + (high - low) * part


def quantile_edges_of(df: DataFrame, columns: list[str], q: int,
                      duplicates: str = "raise") -> dict[str, list[float]]:
    """Edges of ``q`` quantile bins per column, linearly interpolated between values.

    Repeated edges raise, or are dropped with ``duplicates="drop"``. All columns
    are searched together, in a few passes; checkpoint ``df`` if it is costly.
    """
    columns = list(dict.fromkeys(columns))

    def ranks_of(rows: int) -> list[int]:
        return [min(rank + step, rows - 1) for rank, _ in quantile_ranks(rows, q) for step in (0, 1)]

    edges_of = {}
    for column, (rows, value) in zip(columns, order_statistics(df, columns, ranks_of)):
        if rows == 0:
            raise ValueError(f"no values in {column!r} to take quantiles of")
        edges = [interpolate(value[r], value[min(r + 1, rows - 1)], part) for r, part in quantile_ranks(rows, q)]
        distinct = sorted(set(edges))
        if len(distinct) < len(edges) and duplicates == "raise":
            raise ValueError(f"bin edges of {column!r} repeat: {edges}")
        edges_of[column] = distinct if duplicates == "drop" else edges
    return edges_of


def quantile_edges(df: DataFrame, column: str, q: int, duplicates: str = "raise") -> list[float]:
    """Edges of ``q`` quantile bins of one column, as in ``quantile_edges_of``."""
    return quantile_edges_of(df, [column], q, duplicates)[column]


# ---- equal-width edges -----------------------------------------------------

def cut_edges(low: float, high: float, bins: int) -> list[float]:
    """Equal-width edges with the lowest moved down by 0.1 % of the range."""
    if low == high:
        shift = 0.001 * abs(low) if low else 0.001
        low, high = low - shift, high + shift
        return [low + i * ((high - low) / bins) for i in range(bins)] + [high]
    inner = [low + i * ((high - low) / bins) for i in range(1, bins)]
    return [low - (high - low) * 0.001, *inner, float(high)]


def value_range(df: DataFrame, column: str) -> tuple[float, float]:
    row = df.agg(F.min(column).cast("double").alias("low"),
                 F.max(column).cast("double").alias("high")).first()
    return row["low"], row["high"]


def equal_width_edges(df: DataFrame, column: str, bins: int) -> list[float]:
    low, high = value_range(df, column)
    if low is None:
        raise ValueError(f"{column} has no values to bin")
    return cut_edges(low, high, bins)


# ---- bins ------------------------------------------------------------------

def assign_bins(column: str, edges: list[float], *, falling: bool = False) -> Column:
    """Bin 1..n by right-closed edges; null outside them or for null.

    ``falling`` numbers the bins n..1 instead.
    """
    value = F.col(column).cast("double")
    bins = len(edges) - 1
    passed = F.lit(0)
    for edge in edges[1:-1]:
        passed = passed + (value > edge).cast("int")
    number = F.lit(bins) - passed if falling else passed + 1
    # Not a number sorts above every edge and so falls outside, too.
    return F.when((value >= edges[0]) & (value <= edges[-1]), number)


def bin_bounds(df: DataFrame, edges: list[float], column: str = "bin") -> DataFrame:
    """Add ``lower`` and ``upper`` of rising bins."""
    index = F.col(column)
    as_array = F.array(*[F.lit(float(edge)) for edge in edges])
    return df.withColumns({
        "lower": F.get(as_array, index - 1),
        "upper": F.get(as_array, index),
    })


def quantile_bins(df: DataFrame, column: str, q: int, name: str = "bin", *,
                  falling: bool = False, duplicates: str = "raise") -> DataFrame:
    edges = quantile_edges(df, column, q, duplicates)
    return df.withColumn(name, assign_bins(column, edges, falling=falling))


def equal_width_bins(df: DataFrame, column: str, bins: int, name: str = "bin") -> DataFrame:
    return df.withColumn(name, assign_bins(column, equal_width_edges(df, column, bins)))


def mean_per_bin(df: DataFrame, columns: list[str], name: str = "bin") -> DataFrame:
    return df.groupBy(name).agg(*[F.avg(column).alias(f"mean_{column}") for column in columns])


def floor_to_step(column: str, step: int) -> Column:
    """Lower end of the fixed bin of width ``step`` that holds the value."""
    return (F.floor(F.col(column) / step) * step).cast("bigint")


# ---- distributions ---------------------------------------------------------

def density_histogram(df: DataFrame, column: str, width: float, group: str) -> DataFrame:
    """Bars of fixed width from each group's minimum, areas summing to one.

    The last bar is closed on the right. Values are counted before anything
    else is done with them, so equal values travel as one row.
    """
    counted = (
        df.filter(F.col(column).isNotNull()).groupBy(group, F.col(column).alias("v")).count())
    ranges = counted.groupBy(group).agg(
        F.min("v").alias("low"), F.max("v").alias("high"), F.sum("count").alias("rows"))
    last = F.greatest(F.ceil((F.col("high") - F.col("low")) / width) - 1, F.lit(0))
    bar = F.least(F.floor((F.col("v") - F.col("low")) / width), last)
    return (
        counted.join(ranges, group)
        .groupBy(group, bar.cast("bigint").alias("bar"), "low", "rows")
        .agg(F.sum("count").alias("count"))
        .select(
            group, "bar",
            (F.col("low") + F.col("bar") * width).cast("double").alias("lower"),
            "count",
            (F.col("count") / (F.col("rows") * width)).alias("density"),
        )
    )


def shared_edge_histogram(df: DataFrame, column: str, bars: int, group: str) -> DataFrame:
    """Bars on common equal-width edges, heights summing to one in each group."""
    low, high = value_range(df, column)
    if low is None:
        low, high = 0.0, 1.0
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bars
    value = F.col(column).cast("double")
    # Closed on the left, as histogram bars are; the last one on both sides.
    # Counted against the edges themselves, so rounding cannot move a value.
    bar = F.lit(0)
    for index in range(1, bars):
        bar = bar + (value >= low + index * width).cast("int")
    per_bar = df.filter(value.isNotNull()).groupBy(group, bar.cast("bigint").alias("bar")).count()
    rows = F.sum("count").over(Window.partitionBy(group))   # at most ``bars`` rows each
    return per_bar.select(
        group, "bar", (low + F.col("bar") * width).alias("lower"), "count",
        (F.col("count") / rows).alias("probability"))


def grouped_quantiles(counted: DataFrame, group: str, shares: dict[str, float]) -> DataFrame:
    """Interpolated quantiles of every group at once: ``group``, ``rows`` and a column per share.

    ``counted`` has distinct values ``v`` of each group with their ``count``.
    All values are sorted into range chunks by group and value, so a group may
    hold any share of them; a chunk needs only the number of rows in its group's
    earlier chunks. Nothing holds the values of a group together.
    """
    chunks = in_chunks(counted.select(group, "v", "count"), group, "v")
    earlier = Window.partitionBy(group).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    sizes = chunks.groupBy(CHUNK, group).agg(F.sum("count").alias("_n")).select(    # a row per chunk and group
        CHUNK, group, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(group)).alias("rows"))
    inside = (
        Window.partitionBy(CHUNK, group).orderBy(POSITION)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = chunks.withColumn("_inside", F.sum("count").over(inside)).join(sizes, [CHUNK, group]).withColumn(
        "_upto", F.col("_before") + F.col("_inside"))
    rank = lambda share: F.floor((F.col("rows") - 1) * F.lit(share))
    value_at = lambda place: F.min(F.when(F.col("_upto") > place, F.col("v")))
    found = placed.groupBy(group, "rows").agg(*[
        value_at(rank(share) + step).alias(f"_{name}_{step}") for name, share in shares.items() for step in (0, 1)])
    between = lambda name, share: (F.col("rows") - 1) * F.lit(share) - rank(share)
    low = lambda name: F.col(f"_{name}_0")
    return found.select(group, "rows", *[
        (low(name) + F.coalesce((F.col(f"_{name}_1") - low(name)) * between(name, share), F.lit(0.0))).alias(name)
        for name, share in shares.items()])


def box_summary(df: DataFrame, bin_column: str, column: str) -> DataFrame:
    """Quartiles and whiskers per bin.

    Whiskers end at the outermost values within 1.5 interquartile ranges.
    Equal values are counted first, so a bin is a list of distinct values.
    """
    counted = (
        df.filter(F.col(column).isNotNull() & F.col(bin_column).isNotNull())
        .groupBy(bin_column, F.col(column).alias("v")).count())
    boxes = grouped_quantiles(counted, bin_column, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return (
        counted.join(boxes, bin_column)
        .groupBy(bin_column, "rows", "q1", "median", "q3")
        .agg(
            F.min(F.when(F.col("v") >= F.col("q1") - reach, F.col("v"))).alias("whisker_low"),
            F.max(F.when(F.col("v") <= F.col("q3") + reach, F.col("v"))).alias("whisker_high"))
    )


def kernel_density(df: DataFrame, column: str, group: str, points: int = 200,
                   cells: int = DENSITY_CELLS) -> DataFrame:
    """Gaussian kernel density per group on an even grid from min to max.

    Bandwidth is the sample deviation times n**(-1/5); a group whose values are
    all equal has none and is left out. Values are first dealt to the two
    neighbours in a fine even grid, in proportion to their nearness, so the
    cost does not grow with the number of distinct values. With d the distance
    of grid points and h the bandwidth, a density is off by 0.05 (d / h)**2 / h
    at most.
    """
    counted = (
        df.filter(F.col(column).isNotNull())
        .groupBy(group, F.col(column).cast("double").alias("v")).count())
    weight, v = F.col("count"), F.col("v")
    stats = counted.groupBy(group).agg(
        F.min("v").alias("low"), F.max("v").alias("high"), F.sum("count").alias("rows"),
        F.sum(weight * v).alias("s1"), F.sum(weight * v * v).alias("s2"))
    n = F.col("rows")
    spread = F.sqrt((F.col("s2") - F.col("s1") * F.col("s1") / n) / (n - 1))
    stats = stats.filter(F.col("low") < F.col("high")).withColumn(
        "bandwidth", spread * F.pow(n, F.lit(-0.2))).drop("s1", "s2")
    place = (v - F.col("low")) / (F.col("high") - F.col("low")) * (cells - 1)
    cell = F.least(F.floor(place), F.lit(cells - 2))
    sides = F.inline(F.array(
        F.struct(cell.alias("cell"), (weight * (1 - (place - cell))).alias("share")),
        F.struct((cell + 1).alias("cell"), (weight * (place - cell)).alias("share"))))
    binned = counted.join(stats, group).select(*stats.columns, sides).groupBy(*stats.columns, "cell").agg(
        F.sum("share").alias("share"))      # at most ``cells`` rows a group
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")
    x = F.col("low") + F.col("point") * (F.col("high") - F.col("low")) / (points - 1)
    at = F.col("low") + F.col("cell") * (F.col("high") - F.col("low")) / (cells - 1)
    z = (x - at) / F.col("bandwidth")
    return (
        binned.select("*", grid)
        .groupBy(group, "point", x.alias("x"))
        .agg((F.sum(F.col("share") * F.exp(-0.5 * z * z))
              / F.first(n * F.col("bandwidth") * math.sqrt(2 * math.pi))).alias("density"))
    )


def value_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    """How often each pair of values occurs: a scatter plot without repeats."""
    return df.groupBy(x, y).count()
