import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlift.operators import binning, order_statistics
from conftest import rows


def frame(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, x double")


def draws(n, seed=3):
    pick = random.Random(seed)
    return [pick.gauss(0, 1) for _ in range(n)]


@pytest.mark.parametrize("values,q", [
    (draws(997), 10), (draws(1000), 5), (draws(12), 4), ([1.0, 2.0, 3.0], 2), (draws(5001, 9), 8),
])
def test_quantile_bins_like_pandas(spark, values, q):
    got = [r["bin"] for r in binning.quantile_bins(frame(spark, values), "x", q).orderBy("i").collect()]
    assert got == (pd.qcut(values, q, labels=False) + 1).tolist()
    sizes = np.bincount(got)[1:]
    assert sizes.max() - sizes.min() <= 1


def test_falling_labels(spark):
    values = draws(200)
    got = [r["bin"] for r in binning.quantile_bins(
        frame(spark, values), "x", 5, falling=True).orderBy("i").collect()]
    assert got == pd.qcut(values, 5, labels=[5, 4, 3, 2, 1]).tolist()


def test_repeated_edges_raise_or_drop(spark):
    pick = random.Random(5)
    values = [float(pick.choice([0, 0, 0, 0, 1, 2, 3, 40])) for _ in range(400)]
    df = frame(spark, values)
    with pytest.raises(ValueError):
        binning.quantile_bins(df, "x", 8)
    got = [r["bin"] for r in binning.quantile_bins(df, "x", 8, duplicates="drop").orderBy("i").collect()]
    assert got == (pd.qcut(values, 8, labels=False, duplicates="drop") + 1).tolist()


def test_nulls_and_nans_get_no_bin(spark):
    df = frame(spark, [1.0, 2.0, 3.0, 4.0, None, float("nan")])
    got = [r["bin"] for r in binning.quantile_bins(df, "x", 2).orderBy("i").collect()]
    assert got == [1, 1, 2, 2, None, None]


def ranked(values, ranks):
    return {rank: sorted(values)[rank] for rank in ranks}


def test_ranks_beyond_the_sketch(spark, monkeypatch):
    """A sketch that is wrong only costs further rounds."""
    monkeypatch.setattr(order_statistics, "LISTED", 10)
    real, calls = order_statistics._proposed, []

    def misled(rows_, brackets):
        calls.append(len(brackets))
        return [[(45.0, 48.0)] for _ in brackets] if len(calls) == 1 else real(rows_, brackets)

    monkeypatch.setattr(order_statistics, "_proposed", misled)
    values = [float(i % 50) for i in range(1000)]
    (rows_, found), = order_statistics.order_statistics(frame(spark, values), ["x"], lambda n: [0, 499, 999])
    assert (rows_, found) == (1000, ranked(values, [0, 499, 999]))
    assert len(calls) > 1


def test_columns_together_in_rounds(spark, monkeypatch):
    """Several columns, ties at every rank, few values listed: exact against sorting, no pass per column."""
    monkeypatch.setattr(order_statistics, "LISTED", 20)
    monkeypatch.setattr(order_statistics, "ACCURACY", 50)
    pick, n = random.Random(17), 6000
    a = [pick.gauss(0, 1) for _ in range(n)]
    b = [0.5 if pick.random() < 0.7 else 10 ** pick.uniform(-300, 300) * pick.choice([-1, 1]) for _ in range(n)]
    c = [None if pick.random() < 0.3 else float(pick.randint(0, 3000)) for _ in range(n)]
    e = [float("nan")] * n
    df = spark.createDataFrame(list(zip(a, b, c, e)), "a double, b double, c double, e double").repartition(7)
    rounds, real = [], order_statistics._narrowed
    monkeypatch.setattr(order_statistics, "_narrowed", lambda s, k: rounds.append(len(k)) or real(s, k))
    ranks_of = lambda rows_: [rows_ * k // 10 - (k == 10) for k in range(11)]
    got = order_statistics.order_statistics(df, ["a", "b", "c", "e"], ranks_of)
    present = [v for v in c if v is not None]
    for (rows_, found), values in zip(got, (a, b, present)):
        assert rows_ == len(values) and found == ranked(values, ranks_of(rows_))
    assert got[3] == (0, {})
    assert rounds[0] == 3 and len(rounds) <= 6


def test_edges_of_many_columns_are_those_of_each(spark):
    df = frame(spark, draws(800)).withColumn("y", F.pow("x", 2))
    both = binning.quantile_edges_of(df, ["x", "y", "x"], 7)
    assert both == {"x": binning.quantile_edges(df, "x", 7), "y": binning.quantile_edges(df, "y", 7)}
    with pytest.raises(ValueError):
        binning.quantile_edges_of(df.withColumn("z", F.lit(None).cast("double")), ["x", "z"], 7)


@pytest.mark.parametrize("values", [draws(500), [float(i) for i in range(366)], [4.0] * 5, [0.0, 0.0]])
def test_equal_width_bins_like_pandas(spark, values):
    got = [r["bin"] for r in binning.equal_width_bins(frame(spark, values), "x", 5).orderBy("i").collect()]
    assert got == (pd.cut(values, 5, labels=False) + 1).tolist()


def test_density_histogram_like_numpy(spark):
    pick = random.Random(11)
    values = [float(pick.randint(0, 400)) for _ in range(300)]
    df = frame(spark, values).withColumn("g", F.lit("a"))
    edges = np.arange(min(values), max(values) + 28, 28)
    counts, _ = np.histogram(values, edges)
    got = {r["bar"]: r for r in binning.density_histogram(df, "x", 28, "g").collect()}
    assert {b: r["count"] for b, r in got.items()} == {i: c for i, c in enumerate(counts) if c}
    assert sum(r["density"] * 28 for r in got.values()) == pytest.approx(1)


def test_last_bar_takes_the_maximum(spark):
    df = frame(spark, [0.0, 28.0, 56.0]).withColumn("g", F.lit("a"))
    assert [(r["bar"], r["count"]) for r in
            binning.density_histogram(df, "x", 28, "g").orderBy("bar").collect()] == [(0, 1), (1, 2)]


def test_shared_edges_like_numpy(spark):
    pick = random.Random(13)
    values = [float(pick.randint(0, 365)) for _ in range(500)]
    df = frame(spark, values).withColumn("g", F.col("i") % 2)
    edges = np.histogram_bin_edges(values, 50)
    got = binning.shared_edge_histogram(df, "x", 50, "g")
    for group in (0, 1):
        counts, _ = np.histogram(values[group::2], edges)
        assert {r["bar"]: r["count"] for r in got.filter(F.col("g") == group).collect()} == {
            i: c for i, c in enumerate(counts) if c}
    assert got.groupBy("g").agg(F.sum("probability").alias("p")).filter("abs(p - 1) > 1e-9").count() == 0


def test_box_summary_like_numpy(spark):
    values = draws(101) + [9.0]
    row = binning.box_summary(frame(spark, values).withColumn("bin", F.lit(1)), "bin", "x").first()
    q1, median, q3 = np.percentile(values, [25, 50, 75])
    reach = 1.5 * (q3 - q1)
    assert (row["q1"], row["median"], row["q3"]) == pytest.approx((q1, median, q3))
    assert row["whisker_low"] == min(v for v in values if v >= q1 - reach)
    assert row["whisker_high"] == max(v for v in values if v <= q3 + reach) < 9.0


def test_kernel_density_integrates_to_most_of_one(spark):
    values = draws(400)
    got = binning.kernel_density(frame(spark, values).withColumn("g", F.lit(1)), "x", "g").orderBy("point").collect()
    xs, ys = [r["x"] for r in got], [r["density"] for r in got]
    width = np.std(values, ddof=1) * 400 ** -0.2
    expected = [np.mean(np.exp(-0.5 * ((x - np.array(values)) / width) ** 2)) / (width * np.sqrt(2 * np.pi)) for x in xs]
    assert ys == pytest.approx(expected) and 0.9 < np.trapezoid(ys, xs) < 1.01


def test_no_density_without_spread(spark):
    df = frame(spark, [4.0, 4.0, 1.0, 2.0]).withColumn("g", F.col("i") < 2)
    assert {r["g"] for r in binning.kernel_density(df, "x", "g").collect()} == {False}


def test_small_helpers(spark):
    df = frame(spark, [0.0, 4.0, 5.0, -1.0])
    assert [r[0] for r in df.select(binning.floor_to_step("x", 5)).collect()] == [0, 0, 5, -5]
    means = binning.mean_per_bin(df.withColumn("bin", F.col("i") % 2), ["x"])
    assert rows(means, ["bin", "mean_x"]) == [(0, 2.5), (1, 1.5)]


def test_equal_width_edges_need_a_value(spark):
    nothing = spark.createDataFrame([(None,)], "x double")
    with pytest.raises(ValueError, match="no values"):
        binning.equal_width_edges(nothing, "x", 4)


def test_box_of_very_many_values_in_one_bin(spark):
    """A million distinct values in one bin, a few in others, a null bin and null values."""
    many = spark.range(1_000_000).select(F.lit(1).alias("bin"), (F.col("id") * 3 + 1).cast("double").alias("x"))
    few = spark.createDataFrame([(2, 5.0), (3, 1.0), (3, 2.0), (3, 2.0), (3, 50.0), (None, 9.0), (2, None)], "bin int, x double")
    box = binning.box_summary(many.unionByName(few), "bin", "x")
    assert "percentile" not in box._jdf.queryExecution().toString().lower()
    got = {r["bin"]: tuple(r)[1:] for r in box.collect()}
    values = np.arange(1_000_000) * 3.0 + 1
    assert got[1] == pytest.approx((1_000_000, *np.percentile(values, [25, 50, 75]), 1.0, values[-1]))
    assert got[2] == (1, 5.0, 5.0, 5.0, 5.0, 5.0)
    assert got[3] == pytest.approx((4, *np.percentile([1, 2, 2, 50], [25, 50, 75]), 1.0, 2.0)) and len(got) == 3


def test_density_stays_within_its_bound(spark):
    values = np.random.default_rng(4).gamma(2.0, 30.0, 2000)
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 1.0), ("b", 1.0), ("c", None)], "g string, x double")
    h = values.std(ddof=1) * len(values) ** -0.2
    for cells in (512, binning.DENSITY_CELLS):
        found = binning.kernel_density(df, "x", "g", 50, cells).collect()
        assert {r["g"] for r in found} == {"a"} and len(found) == 50
        bound = 0.05 * ((values.max() - values.min()) / (cells - 1) / h) ** 2 / h
        for r in found:
            exact = np.exp(-0.5 * ((r["x"] - values) / h) ** 2).sum() / (len(values) * h * np.sqrt(2 * np.pi))
            assert abs(r["density"] - exact) <= bound + 1e-12
