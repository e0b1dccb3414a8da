"""Sigmoids from raw scores to probabilities, for many groups at once.

Each Newton step is one aggregation over all rows, grouped: whatever the number
of folds and arms, all of them move on together.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_STEPS = 100
# Steps end when no group's mean gradient is larger.
TOLERANCE = 1e-10
# Keeps the equations solvable where all scores of a group are equal.
RIDGE = 1e-12


@dataclass
class Sigmoid:
    """Probability = 1 / (1 + exp(-(slope * score + intercept)))."""
    slope: float
    intercept: float
    positives: int
    negatives: int
    steps: int = 0
    # The last accepted point, its loss, and the step that was taken from there.
    _from: tuple[float, float] = field(default=(0.0, 0.0), repr=False)
    _loss: float = field(default=math.inf, repr=False)
    _move: tuple[float, float] = field(default=(0.0, 0.0), repr=False)

    def advance(self, row) -> bool:
        """Take the sums at the present point in, move on; false when there is nowhere to go."""
        rows = self.positives + self.negatives
        if row["loss"] > self._loss * (1 + 1e-12):      # too far: half the step
            self._move = (self._move[0] / 2, self._move[1] / 2)
            if max(map(abs, self._move)) < 1e-12:
                self.slope, self.intercept = self._from
                return False
        elif max(abs(row["g1"]), abs(row["g0"])) <= TOLERANCE * rows:
            return False
        else:
            h11, h00, h10 = row["h11"] + RIDGE, row["h00"] + RIDGE, row["h10"]
            det = h11 * h00 - h10 * h10
            self._from, self._loss = (self.slope, self.intercept), row["loss"]
            self._move = (-(h00 * row["g1"] - h10 * row["g0"]) / det, -(h11 * row["g0"] - h10 * row["g1"]) / det)
        self.slope, self.intercept = self._from[0] + self._move[0], self._from[1] + self._move[1]
        self.steps += 1
        return True


def _softplus(z: Column) -> Column:
    """log(1 + exp(z)), also for large z."""
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def fit_sigmoids(scored: DataFrame, label: str, score: str, groups: list[str]) -> dict[tuple, Sigmoid]:
    """One sigmoid per combination of ``groups``, by maximum likelihood.

    ``label`` is 0 or 1; rows without label or score do not count. Targets are
    pulled in from 0 and 1 by the class sizes, so a fit exists even where a
    group holds one class or the score parts the classes. Where all scores of a
    group are equal, they tell nothing and the slope stays near 0.

    ``scored`` is read once per step; store it if it is costly. The driver gets
    one row of sums per group and step.
    """
    spark = scored.sparkSession
    positive = F.col(label) == 1
    rows = scored.filter(F.col(label).isNotNull() & F.col(score).isNotNull()).select(
        *groups, positive.alias("_positive"), F.col(score).cast("double").alias("_x"))
    sizes = rows.groupBy(*groups).agg(
        F.count(F.when(F.col("_positive"), 1)).alias("_p"), F.count(F.when(~F.col("_positive"), 1)).alias("_n")
    ).collect()
    fits = {tuple(r[g] for g in groups): Sigmoid(0.0, math.log((r["_p"] + 1) / (r["_n"] + 1)), r["_p"], r["_n"])
            for r in sizes}
    schema = T.StructType(
        [T.StructField(f"_g{k}", scored.schema[g].dataType) for k, g in enumerate(groups)]
        + [T.StructField(name, T.DoubleType()) for name in ("_slope", "_intercept", "_high", "_low")])
    z = F.col("_slope") * F.col("_x") + F.col("_intercept")
    p, x = 1 / (1 + F.exp(-z)), F.col("_x")
    target = F.when(F.col("_positive"), F.col("_high")).otherwise(F.col("_low"))
    weight = p * (1 - p)

    moving = dict(fits)
    for _ in range(MOST_STEPS):
        if not moving:
            break
        # One row per group, counted above.
        point = F.broadcast(spark.createDataFrame([
            (*key, s.slope, s.intercept, (s.positives + 1.0) / (s.positives + 2.0), 1.0 / (s.negatives + 2.0))
            for key, s in moving.items()], schema))
        same = F.lit(True)
        for k, g in enumerate(groups):
            same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
        sums = rows.join(point, same).groupBy(*groups).agg(
            F.sum(target * _softplus(-z) + (1 - target) * _softplus(z)).alias("loss"),
            F.sum((p - target) * x).alias("g1"), F.sum(p - target).alias("g0"),
            F.sum(weight * x * x).alias("h11"), F.sum(weight * x).alias("h10"), F.sum(weight).alias("h00")).collect()
        moving = {key: moving[key] for r in sums if moving[key := tuple(r[g] for g in groups)].advance(r)}
    return fits


def sigmoid_table(scored: DataFrame, label: str, score: str, groups: list[str]) -> DataFrame:
    """``fit_sigmoids`` as a table: the groups, slope, intercept, positives, negatives."""
    fits = fit_sigmoids(scored, label, score, groups)
    schema = T.StructType(
        [T.StructField(g, scored.schema[g].dataType) for g in groups]
        + [T.StructField("slope", T.DoubleType()), T.StructField("intercept", T.DoubleType()),
           T.StructField("positives", T.LongType()), T.StructField("negatives", T.LongType())])
    return scored.sparkSession.createDataFrame(
        [(*key, s.slope, s.intercept, s.positives, s.negatives) for key, s in fits.items()], schema)
