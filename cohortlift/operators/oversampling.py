"""Synthetic minority rows between near neighbours, for mixed features.

A new row lies on the line from a minority row to one of its k nearest
minority neighbours; its categories are the most frequent ones among those
neighbours. Two rows that differ in a category are that much further apart:
half the squared median deviation of the numeric features.

Equal rows are one point with a count, so copies never meet each other. A few
pivots stand in for the space: a point belongs to its nearest pivot and is
placed by its distance to it, so small chunks of points are rings around a
pivot. A chunk keeps the least and greatest distance of its points to every
pivot. By the triangle inequality these tell which chunks can hold a point
nearer than the neighbours found in the own chunk; only those are searched, so
the neighbours are exact.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlift.operators.numbering import (
    CHUNK, POSITION, in_chunks, partition_count, running_totals, stored)

# Points per chunk; all of a chunk's points are compared with each other.
CHUNK_POINTS = 256
# Synthetic rows one task makes at a time from one point.
ROWS_PER_BLOCK = 100_000
NEIGHBOURS = 5
# Pivots grow with the root of the number of chunks, up to this.
MOST_PIVOTS = 64
# Bounds are loosened by this share, since distances are rounded.
SLACK = 1e-9


def _squares(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda total, d: total + d)


def _differing(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.when(p.eqNullSafe(q), 0.0).otherwise(1.0)),
                       F.lit(0.0), lambda total, d: total + d)


def _distance(x: Column, c: Column, y: Column, d: Column, apart: float) -> Column:
    """Squared distance of (numbers, categories) to (numbers, categories)."""
    return _squares(x, y) + _differing(c, d) * F.lit(float(apart))


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest per point, copies counted; ``upto`` is their running count."""
    order = Window.partitionBy("point").orderBy("distance", "other")
    return (
        pairs.withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= k)      # limited in every task before the shuffle
        .withColumn("upto", F.sum("copies").over(order))
        .filter(F.col("upto") - F.col("copies") < k)
        .drop("_rank")
    )


def _with_pivots(points: DataFrame, count: int, apart: float) -> DataFrame:
    """Add ``_to`` (distances to all pivots), ``_cell`` (the nearest one) and ``_away`` (how far it is)."""
    # Any points will do; hash order draws the same ones again.
    chosen = points.orderBy(F.xxhash64("_x", "_c"), "_x", "_c").limit(count).select("_x", "_c").collect()
    pivots = F.from_json(F.lit(json.dumps([{"x": r["_x"], "c": r["_c"]} for r in chosen])),
                         "array<struct<x: array<double>, c: array<string>>>")
    to = F.transform(pivots, lambda p: F.sqrt(_distance(F.col("_x"), F.col("_c"), p["x"], p["c"], apart)))
    return points.withColumn("_to", to).withColumn("_away", F.array_min("_to")).withColumn(
        "_cell", (F.array_position("_to", F.col("_away")) - 1).cast("int"))


def _candidates(rings: DataFrame, pivots: int) -> DataFrame:
    """Pairs of different chunks (``asking``, ``_chunk``) where the one may hold neighbours of the other.

    ``rings``: per chunk its cells' pivots and, for every pivot, the range of
    its points' distances; ``radius`` is the largest search radius inside.
    Cells are compared first, and chunks only within pairs of cells.
    """
    span = lambda low, high: F.struct(low.alias("low"), high.alias("high"))
    spans = rings.select(CHUNK, "_cell", "radius", F.zip_with("low", "high", span).alias("span"))
    # As few rows as there are pivots.
    cells = rings.groupBy("_cell").agg(
        F.max("radius").alias("radius"), F.array(*[F.min(F.col("low")[j]) for j in range(pivots)]).alias("low"),
        F.array(*[F.max(F.col("high")[j]) for j in range(pivots)]).alias("high")).collect()
    low, high = (np.array([r[side] for r in cells]) for side in ("low", "high"))
    reaches = [r["radius"] * (1 + SLACK) + SLACK for r in cells]
    near_cells = rings.sparkSession.createDataFrame([
        (a["_cell"], cells[j]["_cell"]) for i, a in enumerate(cells)
        for j in np.flatnonzero(((low - high[i] <= reaches[i]) & (low[i] - high <= reaches[i])).all(axis=1))
    ], "_cell int, _other_cell int")

    def reaching(a: str, b: str) -> Column:
        """The ranges of ``a``, widened by its radius, meet those of ``b`` at every pivot."""
        reach = F.col(f"{a}.radius") * (1 + SLACK) + SLACK
        return F.forall(F.zip_with(F.col(f"{a}.span"), F.col(f"{b}.span"), lambda p, q: (
            (q["low"] - p["high"] <= reach) & (p["low"] - q["high"] <= reach))), lambda meets: meets)

    return (
        spans.join(F.broadcast(near_cells), "_cell").alias("a")    # MOST_PIVOTS squared at most
        .join(spans.alias("b"), F.col("a._other_cell") == F.col("b._cell"))
        .filter((F.col(f"a.{CHUNK}") != F.col(f"b.{CHUNK}")) & reaching("a", "b"))
        .select(F.col(f"a.{CHUNK}").alias("asking"), F.col(f"b.{CHUNK}").alias(CHUNK), F.col("b.span").alias("span"))
    )


def nearest_neighbours(points: DataFrame, numbers: list[str], categories: list[str],
                       apart: float, k: int = NEIGHBOURS,
                       chunk_points: int = CHUNK_POINTS) -> DataFrame:
    """Exact neighbours of distinct points that carry a count ``copies``.

    Gives the points with an id, and per point rows (``other``, its features,
    ``distance``, ``copies``, ``upto``) covering k neighbours. A point's own
    further copies are its neighbours at distance 0.

    Features travel as one array of numbers and one of categories, so plans do
    not grow with their number.
    """
    types = dict(points.dtypes)
    packed = stored(points.select(
        *points.columns, F.array(*[F.col(c).cast("double") for c in numbers]).cast("array<double>").alias("_x"),
        F.array(*[F.col(c).cast("string") for c in categories]).cast("array<string>").alias("_c")))
    count = packed.count()
    chunks = max(1, -(-count // chunk_points))
    pivots = max(1, min(MOST_PIVOTS, count, 2 * math.isqrt(chunks)))
    parts = max(1, min(chunks, partition_count(points.sparkSession)))
    # A task holds many chunks: stretches of points that follow each other.
    chunk = F.col(CHUNK).cast("bigint") * (1 << 32) + F.floor(F.col(POSITION) / chunk_points)
    ranged = in_chunks(_with_pivots(packed, pivots, apart), "_cell", "_away", "_x", "_c", parts=parts)
    placed = ranged.withColumn("point", F.shiftleft(F.col(CHUNK).cast("bigint"), 33) + F.col(POSITION)).withColumn(
        CHUNK, chunk)
    lean = placed.select("point", CHUNK, "_cell", "_x", "_c", "_to", "copies")
    others = lean.select(F.col("point").alias("other"), CHUNK, "_x", "_c", "copies").alias("b")
    distance = _distance(F.col("a._x"), F.col("a._c"), F.col("b._x"), F.col("b._c"), apart).alias("distance")
    # A point is not its own neighbour, but its further copies are.
    left = F.when(F.col("a.point") == F.col("b.other"), F.col("b.copies") - 1).otherwise(
        F.col("b.copies"))

    def pairs(asking: DataFrame) -> DataFrame:
        return (
            asking.alias("a").join(others, F.col(f"a.{CHUNK}") == F.col(f"b.{CHUNK}"))
            .select("a.point", "b.other", "b._x", "b._c", distance, left.alias("copies"), "a.radius")
            .filter(F.col("copies") > 0)
        )

    def unpacked(near: DataFrame) -> tuple[DataFrame, DataFrame]:
        columns = [F.get("_x", F.lit(j)).alias(c) for j, c in enumerate(numbers)]
        columns += [F.get("_c", F.lit(j)).cast(types[c]).alias(c) for j, c in enumerate(categories)]
        return (placed.select(*points.columns, "point"),
                near.select("point", "other", *columns, "distance", "copies", "upto"))

    nowhere = F.lit(None).cast("double").alias("radius")
    own = _nearest(pairs(lean.select("point", CHUNK, "_x", "_c", nowhere)).drop("radius"), k).checkpoint()
    if chunks == 1:
        return unpacked(own)
    reach = own.groupBy("point").agg(F.when(
        F.max("upto") >= k, F.sqrt(F.max("distance"))).otherwise(F.lit(float("inf"))).alias("radius"))
    searching = lean.drop("copies").join(reach, "point", "left").withColumn(
        "radius", F.coalesce("radius", F.lit(float("inf")))).checkpoint()
    rings = searching.groupBy(CHUNK).agg(
        F.min("_cell").alias("_cell"), F.max("radius").alias("radius"),
        F.array(*[F.min(F.col("_to")[j]) for j in range(pivots)]).alias("low"),
        F.array(*[F.max(F.col("_to")[j]) for j in range(pivots)]).alias("high")).checkpoint()
    reach_of = F.col("radius") * (1 + SLACK) + SLACK
    reachable = F.forall(F.zip_with("_to", "span", lambda t, s: (
        (s["low"] - t <= reach_of) & (t - s["high"] <= reach_of))), lambda meets: meets)
    asking = searching.withColumnRenamed(CHUNK, "asking").drop("_cell").join(
        _candidates(rings, pivots), "asking").filter(reachable).select("point", CHUNK, "_x", "_c", "radius")
    # Nothing as far as the radius can displace a neighbour already known.
    further = pairs(asking).filter(F.col("distance") < F.col("radius") * F.col("radius") * (1 + SLACK)).drop("radius")
    return unpacked(_nearest(own.drop("upto").unionByName(further), k))


def oversample(df: DataFrame, label: str, numbers: list[str], categories: list[str], *,
               k: int = NEIGHBOURS, seed: int = 1234,
               chunk_points: int = CHUNK_POINTS) -> DataFrame:
    """Rows of ``df`` (features and 0/1 label) plus synthetic rows of the rarer
    class, until both classes are of one size.

    Every minority row is used equally often, give or take one. Draws are
    hashes of the point and the copy, so a repeated task repeats its rows.
    """
    features = [*numbers, *categories]
    df = stored(df.select(*features, label))     # read four times, made once
    sizes = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    if len(sizes) != 2:
        raise ValueError(f"{label!r} has {len(sizes)} classes, not two")
    rare = min(sizes, key=sizes.get)
    missing = max(sizes.values()) - sizes[rare]
    if missing == 0:
        return df
    if sizes[rare] <= k:
        raise ValueError(f"{sizes[rare]} rows with {label} = {rare} for {k} neighbours")
    minority = df.filter(F.col(label) == F.lit(rare)).select(
        *[F.col(c).cast("double").alias(c) for c in numbers], *categories)
    spread = minority.agg(*[F.stddev_pop(c).alias(c) for c in numbers]).first()
    median = float(np.median([spread[c] for c in numbers]))
    points = minority.groupBy(*features).agg(F.count("*").alias("copies"))

    # How many rows each point is to give: an equal share per copy, and one
    # more for the first copies in hash order until all are dealt.
    dealt, totals = running_totals(
        points.withColumn("_mix", F.xxhash64(*features, F.lit(seed))),
        [F.col("_mix"), *[F.col(c) for c in features]], {"_upto": F.col("copies")})
    each, rest = divmod(missing, totals["_upto"])
    before = F.col("_upto") - F.col("copies")
    extra = F.least(F.greatest(F.lit(rest) - before, F.lit(0)), F.col("copies"))
    counted = dealt.select(*features, "copies", (F.col("copies") * each + extra).alias("_wanted"))

    placed, neighbours = nearest_neighbours(
        counted, numbers, categories, median * median / 2, k, chunk_points)
    take = F.least(F.col("copies"), F.lit(k) - (F.col("upto") - F.col("copies")))
    repeated = neighbours.withColumn("_turn", F.explode(F.array_repeat(F.lit(1), take.cast("int"))))
    around = repeated.groupBy("point").agg(     # k rows per point
        F.collect_list(F.struct(*numbers)).alias("_ends"),
        *[F.mode(c, True).alias(c) for c in categories])

    blocks = F.explode(F.sequence(
        F.lit(0), F.floor((F.col("_wanted") - 1) / ROWS_PER_BLOCK).cast("int")))
    spread_out = (
        placed.filter(F.col("_wanted") > 0).select("point", "_wanted", *numbers)
        .join(around, "point")
        .withColumn("_block", blocks)
        .repartition("point", "_block")   # one point's rows are made in many tasks
    )
    first = F.col("_block").cast("bigint") * ROWS_PER_BLOCK
    last = F.least(first + ROWS_PER_BLOCK, F.col("_wanted")) - 1
    draw = lambda salt: F.pmod(F.xxhash64("point", "_copy", F.lit(seed + salt)), F.lit(1 << 31))
    made = spread_out.withColumn("_copy", F.explode(F.sequence(first, last))).withColumns({
        "_end": F.get("_ends", F.pmod(draw(1), F.size("_ends")).cast("int")),
        "_part": draw(2) / F.lit(float(1 << 31)),
    })
    types = dict(df.dtypes)
    between = [
        (F.col(c) + F.col("_part") * (F.col(f"_end.{c}") - F.col(c))).cast(types[c]).alias(c)
        for c in numbers
    ]
    synthetic = made.select(*between, *categories, F.lit(rare).cast(types[label]).alias(label))
    return df.unionByName(synthetic)
