"""The recurring jobs: score a signup date, evaluate on held-out users, hand out."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame

from cohortlift.functions.dates import HORIZON_DAYS, Windows, windows_for
from cohortlift.plans import delivery, evaluation, export, uplift
from cohortlift.plans.frames import (
    feature_part, scoring_frame, split_by_arm, split_by_date, training_frame)
from cohortlift.plans.labels import ENTRY_WINDOW_DAYS

LABELS = ["experiment_group", "experiment_group_TR", "experiment_group_CR"]


@dataclass(frozen=True)
class Inputs:
    """The tables a job reads, and what it asks of them."""
    campaign_events: DataFrame
    subscriptions: DataFrame
    engagement_features: DataFrame
    event_features: DataFrame
    country: str = "us"
    subscription_type: str = "b2c"
    horizon: int = HORIZON_DAYS
    window_days: int = ENTRY_WINDOW_DAYS

    def labelled(self, windows: Windows) -> DataFrame:
        """Features and labels of users from the first train to the last test day."""
        frame = training_frame(
            self.campaign_events, self.subscriptions, self.engagement_features,
            self.event_features, windows.train_begin, windows.test_end, horizon=self.horizon,
            window_days=self.window_days, country=self.country,
            subscription_type=self.subscription_type)
        return feature_part(frame, LABELS)

    def to_score(self, begin: dt.date, end: dt.date | None = None,
                 trial_lengths: tuple | None = None) -> DataFrame:
        frame = scoring_frame(
            self.subscriptions, self.engagement_features, self.event_features, begin, end,
            country=self.country, subscription_type=self.subscription_type,
            trial_lengths=trial_lengths)
        return feature_part(frame)


def score_date(inputs: Inputs, signup_date: dt.date, settings=uplift.PRODUCTION, *,
               windows: Windows | None = None, run_date: dt.date | None = None, bins: int = 10,
               falling: bool = False, duplicates: str = "raise",
               trial_lengths: tuple | None = None) -> DataFrame:
    """Train on all users whose outcome is known, score those who signed up on a date."""
    windows = windows or windows_for(signup_date, inputs.horizon)
    _, _, known = split_by_date(inputs.labelled(windows), windows.train_end, windows.test_end)
    models = uplift.fit_both_arms(known, settings)
    scored = uplift.score_users(
        inputs.to_score(signup_date, trial_lengths=trial_lengths), *models)
    binned = uplift.bin_scores(scored, q=bins, falling=falling, duplicates=duplicates)
    return uplift.score_table(binned, run_date)


def evaluate(inputs: Inputs, windows: Windows, settings=uplift.STAGING, *, bins: int = 5,
             falling: bool = True, duplicates: str = "raise") -> dict[str, DataFrame]:
    """Train on the train window and report on the users of the test window.

    ``scores`` holds every test user with propensities, uplift and their bins;
    the reports look at each arm's model on that arm's test users.
    """
    train, test, _ = split_by_date(inputs.labelled(windows), windows.train_end)
    models = uplift.fit_both_arms(train, settings)
    scored = uplift.score_users(test, *models)
    reports, curves, calibration, areas = {}, {}, {}, {}
    arms = zip(("treatment", "control"), split_by_arm(scored), ("TR", "CR"))
    for arm, users, group in arms:
        label, score = f"experiment_group_{group}", f"propensity_{group}"
        reports[arm] = evaluation.classification_report(users, label, score)
        curves[arm] = evaluation.threshold_curve(users, label, score)
        areas[arm] = evaluation.areas(curves[arm])
        calibration[arm] = evaluation.calibration_table(users, label, score)
    return {
        "scores": uplift.bin_scores(
            scored, ["uplift_score", "propensity_TR", "propensity_CN"], bins, falling=falling,
            duplicates=duplicates),
        "report": evaluation.union_reports(reports),
        "curve": evaluation.union_reports(curves),
        "areas": evaluation.union_reports(areas),
        "calibration": evaluation.union_reports(calibration),
    }


def hand_out(scores: DataFrame, signup_date: dt.date, path: str, send=None,
             ledger: str | None = None) -> DataFrame | None:
    """Write a date's batches, and deliver them from there if ``send`` is given.

    With a ``ledger``, ``send`` takes a batch's key as well; only batches that
    the ledger lacks are sent, and the ledger is returned.
    """
    export.export_batches(export.payload_batches(scores, str(signup_date)), path)
    if send is None:
        return None
    schema = "batch_request_num bigint, batch_request_payload array<struct<" \
             "external_id: string, uplift_score_bin: int, uplift_score: double>>"
    batches = scores.sparkSession.read.schema(schema).json(path)
    if ledger is None:
        return export.deliver(batches, send)
    return delivery.deliver(batches, send, ledger, str(signup_date))
