"""Take rates, features, frames, dates and sources."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlift.functions import dates
from cohortlift.functions.expressions import (
    largest_offer, month_start, plan_length, subscriber_kind, uplift, voucher_discount)
from cohortlift.operators import features
from cohortlift.plans import engagement, frames, takerate, winback
from cohortlift.sources import tables
from cohortlift.sources.fixtures import Fixtures
from conftest import SMALL, day, plan_of, rows
from registry import queries as registered
from registry.long_forms import control_curve_by_day


@pytest.fixture(scope="module")
def data(spark):
    return Fixtures(spark, SMALL)


def test_control_curve_is_the_user_day_table(spark, data):
    lapsed = registered._lapsed(data)
    curve = takerate.control_curve(lapsed)
    assert rows(curve) == rows(control_curve_by_day(lapsed)) and curve.count() == 365


@pytest.mark.parametrize("users,q", [(1, 8), (7, 8), (213, 8), (40, 5)])
def test_control_quantile_edges(users, q):
    days = np.repeat(np.arange(1, 366), users)
    assert takerate.control_quantile_edges(users, q) == pytest.approx(
        np.percentile(days, np.linspace(0, 100, q + 1)))


def test_control_cut_edges():
    _, edges = pd.cut(pd.Series(range(1, 366)), 5, retbins=True)
    assert takerate.control_cut_edges(5) == pytest.approx(edges.tolist())


def test_exact_winback_name_has_no_wildcards(spark):
    df = spark.createDataFrame([("winback",), ("Winback 7",), ("Offer 40",), ("Control",), (None,)],
                               "canvas_variation_name string")
    matched = lambda pattern: {r[0] for r in df.filter(winback.in_offer_variation(pattern)).collect()}
    assert matched("winback") == {"winback", "Offer 40"}
    assert matched("%winback%") == {"winback", "Winback 7", "Offer 40"}


def wide(spark):
    values = {f"day{k}_plays": k + 1 for k in range(8)} | {f"day{k}_distinct_x": 9 for k in range(8)}
    return spark.createDataFrame([(1, *values.values())], ["hs_user_id", *values])


def test_week_sums_leave_out_day_7_and_distincts(spark):
    df = features.with_week_sums(wide(spark))
    assert df.first()["week1_plays"] == sum(range(1, 8))
    assert not [c for c in df.columns if c.startswith("week1") and "distinct" in c]


def test_second_week_covers_days_7_to_13(spark):
    df = spark.createDataFrame([tuple(range(14))], [f"day{k}_f" for k in range(14)])
    assert df.select(features.week_sum("f", 2)).first()[0] == sum(range(7, 14))


def test_trends(spark):
    row = wide(spark).select(
        features.trailing_average("plays", 3), features.week1_slope("plays")).first()
    assert row["day3_trailing3day_avg_plays"] == pytest.approx(3)
    averages = {k: k for k in range(3, 8)}   # mean of k-1, k, k+1
    expected = np.mean([averages[k] / (averages[k - 1] + 1e-8) - 1 for k in (7, 6, 5, 4)])
    assert row["week1_plays_slope"] == pytest.approx(expected)
    weeks = spark.createDataFrame([(1, 2, 4, 8)], ["week1_f", "week2_f", "week3_f", "week4_f"])
    assert weeks.select(features.weeks_2_to_4("f")).first()["week_2to4_f"] == 14


def test_missing_values(spark):
    df = spark.createDataFrame([(None, None, None, None)],
                               "n long, subscription_platform string, other string, d date")
    assert tuple(features.fill_missing(df).first()) == (0, "0", None, None)


def test_feature_columns_are_sorted_parts():
    assert features.feature_columns(
        ["week1_z", "day0_z", "free_trial_days", "renewal_count", "max_discount_offered_c"]) == [
        "free_trial_days", "max_discount_offered_c", "plan_renewal_term_months_c", "renewal_c",
        "renewal_count", "subscription_platform", "week1_z"]


def test_expressions(spark):
    df = spark.createDataFrame(
        [(1, 0, "SAVE20OFF", day("2021-03-31"), 0, 0, 1, .6, .1), (12, 2, "off", day("2020-02-29"), 1, 1, 1, .2, .9),
         (6, None, None, None, 0, 0, 0, .5, .5)],
        "term int, renewals int, voucher string, d date, num_offers_40 int, num_offers_30 int,"
        " num_offers_20 int, tr double, cr double")
    got = df.select(plan_length("term"), subscriber_kind("renewals"), voucher_discount("voucher"),
                    month_start("d"), largest_offer(), uplift(F.col("tr"), F.col("cr"))).collect()
    assert [tuple(r)[:5] for r in got] == [
        ("monthly", "new", 20, day("2021-03-01"), 20),
        ("annual", "returning", None, day("2020-02-01"), 40),
        ("other", "new", None, None, 0)]
    assert [r[5] for r in got] == pytest.approx([1.0, -1.4, 0.0], abs=1e-12)


def test_windows():
    w = dates.windows_for(dt.date(2022, 6, 1))
    assert (w.test_end, w.test_begin) == (dt.date(2022, 4, 19), dt.date(2022, 3, 23))
    assert (w.train_end, w.train_begin) == (dt.date(2022, 3, 22), dt.date(2021, 3, 22))
    assert dates.default_scoring_date(dt.date(2022, 6, 8)) == dt.date(2022, 6, 1)
    back = dates.dates_back(dt.date(2022, 5, 31), 31)
    assert (back[0], back[-1], len(back)) == (dt.date(2022, 5, 31), dt.date(2022, 5, 1), 31)


def test_unknown_cohort_raises(data):
    with pytest.raises(ValueError):
        frames.user_cohort("winback", data.subscriptions, "us", "b2c", day("2020-01-01"), day("2020-01-02"))


def test_fixture_tables_fit_their_declarations(data):
    for table in ("subscriptions", "campaign_events", "campaigns", "engagement_features", "event_features"):
        tables.check_columns(getattr(data, table), table)
    with pytest.raises(ValueError, match="canvas_id: missing"):
        tables.check_columns(data.campaign_events.drop("canvas_id"), "campaign_events")


def test_load_by_path_and_name_pushes_filters(spark, data, tmp_path):
    data.engagement_features.write.parquet(str(tmp_path / "e"))
    stored = tables.load(spark, "engagement_features", str(tmp_path / "e"))
    part = tables.features_between(stored, day("1996-01-01"), day("1996-12-31")).select("day0_content_starts")
    plan = plan_of(part)
    assert "PushedFilters: [IsNotNull(signup_date), GreaterThanOrEqual(signup_date" in plan
    assert "day1_content_starts" not in plan
    stored.createOrReplaceTempView("engagement_by_name")
    named = tables.load(spark, "engagement_features", name="engagement_by_name")
    assert named.count() == stored.count()
    one = stored.first()["hs_user_id"]
    assert tables.user_history(stored, [one]).filter(F.col("hs_user_id") != one).count() == 0


def test_cohort_range_is_inclusive_and_case_blind(spark):
    df = spark.createDataFrame(
        [(1, day("2020-01-01"), "B2C", "us"), (2, day("2020-01-31"), "b2c", "US"),
         (3, day("2020-02-01"), "B2C", "US"), (4, None, "B2C", "US"), (5, day("2020-01-05"), "B2B", "US")],
        "hs_user_id long, free_trial_start_date date, subscription_type string, country_code string"
    ).withColumn("dt", F.col("free_trial_start_date"))
    got = frames.dropout_cohort(df, "us", "b2c", day("2020-01-01"), day("2020-01-31"))
    assert {r["hs_user_id"] for r in got.collect()} == {1, 2}


def test_splits(data):
    frame = registered._training(data).select("hs_user_id", "signup_date", "experiment_group")
    train, test, final = frames.split_by_date(frame, day("2000-06-30"))
    assert train.count() + test.count() == final.count() == frame.count()
    treatment, control = frames.split_by_arm(frame)
    assert treatment.count() + control.count() == frame.count()


def test_weighted_median(spark):
    df = spark.createDataFrame([(5, 1), (1, 2), (9, 3), (1, 1)], "v int, w int")
    # 1 1 1 5 9 9 9: the fourth of seven
    assert engagement.weighted_median(df, "v", "w").first()[0] == 5
