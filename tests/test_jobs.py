"""The jobs end to end, with small forests, on tables that span years."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortlift.functions.dates import Windows
from cohortlift.plans import export, jobs, uplift
from cohortlift.sources.fixtures import Fixtures

YEARS = Windows(dt.date(1990, 1, 1), dt.date(1999, 6, 30), dt.date(1999, 7, 1), dt.date(2010, 12, 31))
QUICK = uplift.ForestSettings(trees=4, folds=2, max_depth=4)


@pytest.fixture(scope="module")
def inputs(spark):
    data = Fixtures(spark, "/root/testdata/sf0.01")
    return jobs.Inputs(data.campaign_events, data.subscriptions, data.engagement_features,
                       data.event_features, horizon=365, window_days=365)


def test_score_and_hand_out(spark, inputs, tmp_path):
    date = (inputs.subscriptions.filter(
        "free_trial_start_date is not null and subscription_type = 'B2C' and country_code = 'US'")
        .groupBy("dt").count().orderBy(F.desc("count"), "dt").first()["dt"])
    scores = jobs.score_date(inputs, date, QUICK, windows=YEARS, run_date=dt.date(2002, 1, 1),
                             bins=2, duplicates="drop")
    assert scores.columns == export.SCORE_COLUMNS
    users = {r["hs_user_id"] for r in scores.collect()}
    assert users and {r["signup_date"] for r in scores.collect()} == {str(date)}
    out = str(tmp_path)

    def send(batch):
        for user in batch:
            open(f"{out}/user-{user['external_id']}", "w").close()

    jobs.hand_out(scores, date, f"{out}/batches", send)
    assert {int(f.name.removeprefix("user-")) for f in tmp_path.glob("user-*")} == users


def test_evaluation_covers_both_arms(inputs):
    result = jobs.evaluate(inputs, YEARS, QUICK, bins=2, duplicates="drop")
    assert {r["model"] for r in result["areas"].collect()} == {"treatment", "control"}
    for r in result["areas"].collect():
        assert 0 <= r["roc_auc"] <= 1 and 0 <= r["pr_auc"] <= 1
    support = {r["model"]: r["support"] for r in
               result["report"].filter(F.col("class") == "accuracy").collect()}
    assert sum(support.values()) == result["scores"].count()
    assert {"uplift_score_bin", "propensity_TR_bin", "propensity_CN_bin"} <= set(result["scores"].columns)
