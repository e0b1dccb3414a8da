"""Grouped sigmoids and forests scored as arrays, against Spark ML's own results."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from cohortlift.operators import forests
from cohortlift.plans import calibration


@pytest.fixture(scope="module")
def scored(spark):
    pick = random.Random(3)
    rows = []
    for group, shift, size in (("a", 0.0, 400), ("b", 2.0, 90), (None, -1.0, 60)):
        for _ in range(size):
            x = pick.random()
            rows.append((group, size % 7, int(pick.random() < 1 / (1 + math.exp(-(5 * x - 2 + shift)))), x))
    rows += [("one class", 1, 1, pick.random()) for _ in range(20)]
    rows += [("equal scores", 1, k % 3 == 0, 0.25) for k in range(30)]
    rows += [("parted", 1, int(k >= 20), k / 40) for k in range(40)]
    rows += [("a", 400 % 7, None, 0.5), ("a", 400 % 7, 1, None)]
    return spark.createDataFrame([(g, k, None if y is None else int(y), x) for g, k, y, x in rows],
                                 "g string, k int, y int, x double"), rows


def test_sigmoids_match_one_regression_each(spark, scored):
    df, rows = scored
    fits = calibration.fit_sigmoids(df, "y", "x", ["g", "k"])
    assert len(fits) == 6
    for (group, _), fit in fits.items():
        own = [(y, x) for g, _, y, x in rows if g == group and y is not None and x is not None]
        p, n = sum(bool(y) for y, _ in own), sum(not y for y, _ in own)
        assert (fit.positives, fit.negatives) == (p, n) and fit.steps < 30
        target = np.array([(p + 1) / (p + 2) if y else 1 / (n + 2) for y, _ in own])
        x = np.array([x for _, x in own])
        off = 1 / (1 + np.exp(-(fit.slope * x + fit.intercept))) - target
        assert abs(off.sum()) < 1e-6 and abs((off * x).sum()) < 1e-6
    p = fits["b", 90 % 7].positives
    halves = [(float(side), w if side else 1 - w, [x]) for g, _, y, x in rows if g == "b"
              for w in [(p + 1) / (p + 2) if y else 1 / (90 - p + 2)] for side in (1, 0)]
    one = LogisticRegression(labelCol="s", weightCol="w", maxIter=200, tol=1e-12).fit(
        spark.createDataFrame(halves, "s double, w double, f array<double>").withColumn("features", array_to_vector("f")))
    assert (fits["b", 90 % 7].slope, fits["b", 90 % 7].intercept) == pytest.approx((one.coefficients[0], one.intercept), abs=1e-4)


def test_no_rows_no_sigmoids(scored):
    df, _ = scored
    assert calibration.fit_sigmoids(df.filter("false"), "y", "x", ["g"]) == {}
    table = calibration.sigmoid_table(df.filter("g = 'parted'"), "y", "x", ["g"]).first()
    assert table["g"] == "parted" and table["slope"] > 10 and table["positives"] == 20


def test_a_step_too_far_is_halved():
    fit = calibration.Sigmoid(0.0, 0.0, 5, 5)
    sums = {"loss": 7.0, "g1": -1.0, "g0": 1.0, "h11": 1.0, "h10": 0.0, "h00": 1.0}
    assert fit.advance(sums) and (fit.slope, fit.intercept) == pytest.approx((1, -1))
    assert fit.advance(sums | {"loss": 9.0}) and (fit.slope, fit.intercept) == pytest.approx((.5, -.5))
    assert fit.advance(sums | {"loss": 6.0}) and (fit.slope, fit.intercept) == pytest.approx((1.5, -1.5))
    assert not fit.advance(sums | {"loss": 5.0, "g1": 0.0, "g0": 0.0})


@pytest.fixture(scope="module")
def grown(spark):
    rng = np.random.default_rng(6)
    data = np.round(rng.normal(size=(700, 6)), 1)
    label = (data[:, 0] * data[:, 1] + rng.normal(size=700) > 0).astype(float)
    df = spark.createDataFrame([(k, row.tolist(), y, k % 3) for k, (row, y) in enumerate(zip(data, label.tolist()))],
                               "k int, f array<double>, label double, fold int").withColumn("features", array_to_vector("f"))
    return df, [RandomForestClassifier(numTrees=n, maxDepth=depth, seed=n).fit(df.filter(F.col("fold") != fold))
                for fold, (n, depth) in enumerate([(7, 9), (1, 2), (12, 5)])]


def test_array_trees_score_as_the_models(spark, grown):
    df, models = grown
    trees = forests.flat_trees(spark, models)
    assert trees.members == 3 and len(trees.roots) == 20
    alone = forests.scored_by_all(df, F.col("f"), trees, "raws")
    own = {r["k"]: r["raw"] for r in forests.scored_by_own(df, F.col("f"), "fold", trees, "raw").collect()}
    got = {r["k"]: r["raws"] for r in alone.collect()}
    for member, model in enumerate(models):
        for r in model.transform(df).select("k", "fold", vector_to_array("probability")[1].alias("p")).collect():
            assert abs(got[r["k"]][member] - r["p"]) < 1e-12
            if r["fold"] == member:
                assert abs(own[r["k"]] - r["p"]) < 1e-12


def test_forests_too_large_or_with_categories_are_left_to_the_models(spark, grown, monkeypatch):
    df, models = grown
    assert forests.flat_trees(spark, []) is None
    monkeypatch.setattr(forests, "MOST_NODES", 10)
    assert forests.flat_trees(spark, models) is None


def test_walking_in_small_pieces_and_no_rows(spark, grown, monkeypatch):
    df, models = grown
    trees = forests.flat_trees(spark, models)
    rows = np.array([r["f"] for r in df.collect()])
    whole = trees.score(rows)
    monkeypatch.setattr(forests, "WALKED_TOGETHER", 45)
    assert np.array_equal(trees.score(rows), whole) and trees.score(rows[:0]).shape == (0, 3)
