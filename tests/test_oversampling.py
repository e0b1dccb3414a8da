import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlift.operators import oversampling
from cohortlift.operators.oversampling import nearest_neighbours, oversample

NUMBERS, CATEGORIES = ["x", "y"], ["c"]
APART = 2.0


def make_points(spark, n, seed=1):
    pick = random.Random(seed)
    seen = {(float(pick.randint(0, 60)), pick.gauss(0, 5), pick.choice("abc")) for _ in range(n)}
    return spark.createDataFrame([(*p, pick.choice([1, 1, 1, 2, 9])) for p in sorted(seen)],
                                 "x double, y double, c string, copies long")


def brute_force(points, k):
    """k nearest squared distances per point, own further copies at 0."""
    rows = [(r["x"], r["y"], r["c"], r["copies"]) for r in points.collect()]
    out = {}
    for i, (x, y, c, n) in enumerate(rows):
        all_of = []
        for j, (x2, y2, c2, n2) in enumerate(rows):
            d = (x - x2) ** 2 + (y - y2) ** 2 + (APART if c != c2 else 0)
            all_of += [d] * min(n2 - (i == j), k)
        out[(x, y, c)] = sorted(all_of)[:k]
    return out


@pytest.mark.parametrize("chunk", [1000, 16, 3])
def test_neighbours_are_exact_however_small_the_chunks(spark, chunk):
    points = make_points(spark, 150)
    placed, near = nearest_neighbours(points, NUMBERS, CATEGORIES, APART, 5, chunk)
    features = {r["point"]: (r["x"], r["y"], r["c"]) for r in placed.collect()}
    got = {}
    for r in sorted(near.collect(), key=lambda r: (r["point"], r["upto"])):
        take = min(r["copies"], 5 - (r["upto"] - r["copies"]))
        got.setdefault(features[r["point"]], []).extend([r["distance"]] * take)
    want = brute_force(points, 5)
    assert set(got) == set(want)
    for point, distances in want.items():
        assert got[point] == pytest.approx(distances)


@pytest.mark.parametrize("wide", [64, 100])
def test_neighbours_of_wide_points(spark, wide):
    names = [f"n{i}" for i in range(wide)]
    values = np.random.default_rng(5).integers(0, 9, (40, wide)).astype(float)
    points = spark.createDataFrame([(*map(float, v), 1) for v in values], [*names, "copies"])
    placed, near = nearest_neighbours(points, names, [], APART, 3, 16)
    who = {r["point"]: tuple(r[n] for n in names) for r in placed.collect()}
    got = {}
    for r in near.collect():
        got.setdefault(who[r["point"]], []).append(r["distance"])
    for v in values:
        want = sorted(((values - v) ** 2).sum(axis=1))[1:4]     # the first is the point itself
        assert sorted(got[tuple(v)])[:3] == pytest.approx(want)


def test_few_pairs_are_compared_where_points_lie_in_groups(spark, monkeypatch):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(15, 100)) * 10
    values = centres[rng.integers(0, 15, 600)] + rng.normal(size=(600, 100))
    names = [f"n{i}" for i in range(100)]
    points = spark.createDataFrame([(*map(float, v), "a", 1) for v in values], [*names, "c", "copies"])
    compared, nearest = [], oversampling._nearest

    def counting(pairs, k):
        compared.append(pairs.count())
        return nearest(pairs, k)

    monkeypatch.setattr(oversampling, "_nearest", counting)
    placed, near = nearest_neighbours(points, names, ["c"], APART, 3, 16)
    found = near.groupBy("point").agg(F.sort_array(F.collect_list("distance"))[2].alias("d")).join(placed, "point").collect()
    for r in found[::25]:
        own = np.array([r[n] for n in names])
        assert r["d"] == pytest.approx(np.sort(((values - own) ** 2).sum(axis=1))[3])
    assert len(found) == 600 and sum(compared) < 0.2 * 600 * 600


@pytest.fixture(scope="module")
def lopsided(spark):
    pick = random.Random(8)
    rows = [(pick.randint(0, 50), pick.random(), pick.choice("abc"), 0) for _ in range(300)]
    rows += [(pick.randint(100, 120), 5 + pick.random(), pick.choice("ab"), 1) for _ in range(40)]
    rows += [(110, 5.5, "a", 1)] * 20     # a third of the minority are copies
    return spark.createDataFrame(rows, "x int, y double, c string, label int")


def test_classes_end_up_level_and_new_rows_lie_between(lopsided):
    out = oversample(lopsided, "label", NUMBERS, CATEGORIES)
    assert {r["label"]: r["count"] for r in out.groupBy("label").count().collect()} == {0: 300, 1: 300}
    assert out.dtypes == lopsided.select(*NUMBERS, *CATEGORIES, "label").dtypes
    bounds = out.filter("label = 1").agg(
        F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.collect_set("c")).first()
    assert 100 <= bounds[0] and bounds[1] <= 120 and 5 <= bounds[2] and bounds[3] <= 6
    assert set(bounds[4]) <= {"a", "b"}
    # The originals are all still there.
    assert lopsided.exceptAll(out).count() == 0


def test_copies_only_repeat_themselves(lopsided):
    """Twenty copies are each other's neighbours, so their rows are copies too."""
    out = oversample(lopsided, "label", NUMBERS, CATEGORIES)
    copies = out.filter("x = 110 and y = 5.5 and c = 'a'").count()
    assert copies >= 20 + 20 * (240 // 60)


def test_same_seed_same_rows(lopsided):
    first = oversample(lopsided, "label", NUMBERS, CATEGORIES, chunk_points=8)
    second = oversample(lopsided, "label", NUMBERS, CATEGORIES, chunk_points=8)
    third = oversample(lopsided, "label", NUMBERS, CATEGORIES, seed=5)
    assert first.exceptAll(second).count() == 0
    assert first.exceptAll(third).count() > 0


def test_numbers_of_a_new_row_share_one_step(spark):
    rows = [(float(i), float(2 * i), "a", 1) for i in range(8)] + [(0., 0., "b", 0)] * 40
    df = spark.createDataFrame(rows, "x double, y double, c string, label int")
    out = oversample(df, "label", NUMBERS, CATEGORIES).filter("label = 1").collect()
    assert len(out) == 40 and all(np.isclose(r["y"], 2 * r["x"]) for r in out)


def test_refuses_what_it_cannot_do(spark, lopsided):
    with pytest.raises(ValueError, match="neighbours"):
        oversample(lopsided.filter("label = 0 or x = 100"), "label", NUMBERS, CATEGORIES, k=30)
    with pytest.raises(ValueError, match="classes"):
        oversample(lopsided.filter("label = 0"), "label", NUMBERS, CATEGORIES)
    level = spark.createDataFrame([(1, 1., "a", 0), (2, 1., "a", 1)], "x int, y double, c string, label int")
    assert oversample(level, "label", NUMBERS, CATEGORIES).count() == 2


def test_the_frame_is_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        made.add(1)
        return float(x)

    df = spark.range(300).select(
        counted("id").alias("x"), (F.col("id") % 7).cast("double").alias("y"),
        (F.col("id") % 3).cast("string").alias("c"), (F.col("id") % 5 == 0).cast("int").alias("label"))
    filled = oversample(df, "label", ["x", "y"], ["c"])
    assert {r["label"]: r["count"] for r in filled.groupBy("label").count().collect()} == {0: 240, 1: 240}
    assert made.value == 300
