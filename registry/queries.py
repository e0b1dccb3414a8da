"""Every registered query, over the tables derived from one test-data folder.

The test data lies in 1995-2001, and its campaigns and subscriptions are far
apart, so windows and horizons are wider here than the library's defaults
(FIXTURES.md section 6). All queries run over whole tables.
"""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlift.functions.dates import windows_for
from cohortlift.functions.expressions import plan_length, subscriber_kind
from cohortlift.operators import binning, campaigns, features, oversampling
from cohortlift.operators.intervals import join_running
from cohortlift.operators.numbering import number_rows, use_checkpoint_folder
from cohortlift.operators.sequences import BY_DATE, with_ordinal
from cohortlift.operators.skew import HEAVY_ROWS, Heavy, heavy_keys
from cohortlift.plans import (
    calibration, delivery, engagement, evaluation, export, frames, funnel, labels, takerate, tracking,
    uplift, winback)
from cohortlift.sources import bucketed, footers, tables
from cohortlift.sources.fixtures import Fixtures

BEGIN, END = dt.date(1990, 1, 1), dt.date(2010, 12, 31)
HORIZON = WINDOW = 365
WINBACK_SINCE = dt.date(1996, 1, 1)
LAPSED = (dt.date(1996, 1, 1), dt.date(2001, 12, 31))
FEATURE_RANGE = (dt.date(1996, 1, 1), dt.date(2000, 12, 31))
TRAIN_END = dt.date(2000, 6, 30)
MARKET = {"country": "us", "subscription_type": "b2c"}
RUN_DATE = dt.date(2022, 6, 1)
ENTRY_SINCE = dt.date(1996, 1, 1)
# No user of the test data reaches the library's default; users with this many
# subscriptions take the way of heavy ones in the queries named after them.
MANY_ROWS = 8
BUCKETS = 8

_heavy: dict = {}


def _heavy_users(data: Fixtures, at_least: int = HEAVY_ROWS) -> Heavy:
    """Heavy users of a folder, looked up once per Spark application."""
    key = (data.spark.sparkContext.applicationId, data.folder, at_least)
    if key not in _heavy:
        _heavy[key] = heavy_keys(data.subscriptions, "hs_user_id", at_least)
    return _heavy[key]


def _rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Doubles that depend on the order of summing are compared rounded."""
    return df.withColumns({c: F.round(c, places) for c in columns})


def _stored(df: DataFrame) -> DataFrame:
    """Compute once what is read several times, as for edges and then bins."""
    use_checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder where checkpoints go."""
    use_checkpoint_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


# ---- sources ---------------------------------------------------------------

def user_cohort(data):
    return frames.user_cohort(frames.DROPOUT_COHORT, data.subscriptions, begin=BEGIN, end=END,
                              **MARKET)


def latest_date(data):
    return tables.latest_date(data.engagement_features)


def available_dates(data):
    return tables.available_dates(data.engagement_features)


def latest_stored_date(data):
    path = _folder(data.spark, "engagement")
    data.engagement_features.write.parquet(path)
    return footers.latest_stored_date(data.spark, path)


def stored_dates(data):
    """From a folder divided by date."""
    path = _folder(data.spark, "engagement_by_date")
    export.write_scores(data.engagement_features, path)
    return footers.stored_dates(data.spark, path)


def engagement_feature_range(data):
    return tables.features_between(data.engagement_features, *FEATURE_RANGE)


def event_feature_range(data):
    return tables.features_between(data.event_features, *FEATURE_RANGE)


def user_history(data):
    """History of the user with most subscriptions (the lower id on a tie)."""
    subscriptions = data.subscriptions
    busiest = (
        subscriptions.groupBy("hs_user_id").count()
        .orderBy(F.desc("count"), "hs_user_id").limit(1))
    return tables.user_history(subscriptions, busiest)


# ---- campaigns -------------------------------------------------------------

def _dropout_rollup(data):
    return campaigns.dropout_rollup(data.campaign_events, BEGIN, END)


def _winback_rollup(data):
    return campaigns.winback_rollup(data.campaign_events, WINBACK_SINCE)


def campaign_rollup_dropout(data):
    return _dropout_rollup(data)


def campaign_rollup_by_id(data):
    return campaigns.dropout_rollup(data.campaign_events, canvas_id=2, entered_since=ENTRY_SINCE)


def campaign_rollup_winback(data):
    return _winback_rollup(data)


def campaign_rollup_group(data):
    return campaigns.winback_group_rollup(data.campaign_events)


def variation_counts(data):
    return campaigns.users_per_variation(campaigns.dropout_rollup(
        data.campaign_events, canvas_id=2, entered_since=ENTRY_SINCE))


def events_by_variation(data):
    return tracking.events_by_variation(data.campaign_events)


# ---- sequences and joins ---------------------------------------------------

def forward_interval_nearest(data, heavy=None):
    return labels.nearest_after_entry(
        _dropout_rollup(data), data.subscriptions, WINDOW,
        _heavy_users(data) if heavy is None else heavy
    ).select("hs_user_id", "canvas_variation_name", "canvas_entry_date", "dt", "subscription_id",
             *labels.NEXTS)


def forward_interval_nearest_heavy(data):
    return forward_interval_nearest(data, _heavy_users(data, MANY_ROWS))


def _lapsed(data):
    return winback.lapsed_users(_winback_rollup(data), data.subscriptions, *LAPSED,
                                heavy=_heavy_users(data), **MARKET)


def backward_nearest(data):
    return _lapsed(data).select(
        "hs_user_id", "subscription_id", "canvas_variation_name", "canvas_entry_date",
        "paid_subscription_end_date", "next_paid_subscription_start_date", "next_voucher_code")


def validity_interval_join(data):
    entries = (
        campaigns.choose_events(data.campaign_events, name_pattern=campaigns.WINBACK_NAMES,
                                kinds=[campaigns.ENTRY])
        .select(F.col("external_user_id").alias("hs_user_id"), "canvas_id",
                "canvas_variation_name", F.col("dt").alias("event_date")))
    sequenced = funnel.subscription_sequence(data.subscriptions, _heavy_users(data))
    return join_running(entries, sequenced).select(
        "hs_user_id", "canvas_id", "canvas_variation_name", "event_date", "subscription_id",
        F.col("dt").alias("subscription_start_date"), "next_subscription_start_date",
        "next_paid_subscription_start_date")


def next_subscription(data, heavy=None):
    heavy = _heavy_users(data) if heavy is None else heavy
    sequenced = winback.paid_sequence(data.subscriptions, heavy=heavy, **MARKET)
    return with_ordinal(sequenced, "hs_user_id", BY_DATE, heavy=heavy).select(
        "hs_user_id", "subscription_id", "dt", "voucher_code", "next_voucher_code",
        "paid_subscription_start_date", "next_paid_subscription_start_date", "sub_rank")


def next_subscription_heavy(data):
    return next_subscription(data, _heavy_users(data, MANY_ROWS))


# ---- labels ----------------------------------------------------------------

def experiment_labels(data):
    return labels.experiment_labels(
        data.campaign_events, data.subscriptions, BEGIN, END, HORIZON, WINDOW,
        heavy=_heavy_users(data))


def experiment_labels_by_campaign(data):
    return labels.experiment_labels(
        data.campaign_events, data.subscriptions, BEGIN, END, HORIZON, WINDOW, canvas_id=2,
        heavy=_heavy_users(data))


def winback_target(data, heavy=None):
    return winback.winback_target(
        campaigns.winback_group_rollup(data.campaign_events), data.subscriptions,
        heavy=_heavy_users(data) if heavy is None else heavy)


def winback_target_heavy(data):
    return winback_target(data, _heavy_users(data, MANY_ROWS))


# ---- win-back reports ------------------------------------------------------

def winback_responders_control(data):
    return winback.control_responders(_lapsed(data))


def winback_responders_treatment(data):
    return winback.treatment_responders(_lapsed(data))


def returns_by_voucher(data):
    return takerate.returns_by_voucher(_lapsed(data))


def _conversions(data):
    return takerate.treatment_conversions(_lapsed(data))


def take_rate_treatment(data):
    """Take rate per eighth of the days since lapsing."""
    year = _stored(takerate.within_year(_conversions(data)))
    edges = binning.quantile_edges(year, "days_since_cancel", 8, "drop")
    return takerate.treatment_rate_by_bin(year, edges)


def take_rate_treatment_equal_width(data):
    year = _stored(takerate.within_year(_conversions(data)))
    return takerate.treatment_rate_by_bin(
        year, binning.equal_width_edges(year, "days_since_cancel", 5))


def take_rate_treatment_users(data):
    return _conversions(data)


def take_rate_control_curve(data):
    return takerate.control_curve(_lapsed(data))


def take_rate_control(data):
    curve = _stored(takerate.control_curve(_lapsed(data)))
    users = curve.agg(F.max("users")).first()[0] or 1
    return takerate.control_rate_by_bin(curve, takerate.control_quantile_edges(users, 8))


def take_rate_control_equal_width(data):
    return takerate.control_rate_by_bin(
        takerate.control_curve(_lapsed(data)), takerate.control_cut_edges(5))


def take_rate_10day_treatment(data):
    return takerate.treatment_rate_by_ten_days(_conversions(data))


def take_rate_10day_control(data):
    return takerate.control_rate_by_ten_days(takerate.control_curve(_lapsed(data)))


def campaign_funnel(data):
    return funnel.campaign_funnel(data.campaign_events, data.campaigns, data.subscriptions,
                                  heavy=_heavy_users(data))


# ---- features and frames ---------------------------------------------------

def daily_features_week1(data):
    both = data.engagement_features.join(data.event_features, frames.KEYS, "left")
    return features.with_week_sums(features.fill_missing(both)).select(
        *frames.KEYS, "week1_content_starts", "week1_returns")


def feature_trends(data):
    return data.engagement_features.select(
        *frames.KEYS,
        *[F.round(features.trailing_average("content_starts", day), 6)
          .alias(f"day{day}_trailing3day_avg_content_starts") for day in range(3, 8)],
        # Relative changes over a near-zero day are huge, so compare the log.
        F.round(F.signum(features.week1_slope("content_starts"))
                * F.log1p(F.abs(features.week1_slope("content_starts"))), 6)
        .alias("week1_content_starts_log_slope"))


def median_daily_total(data):
    return engagement.median_daily_total(data.engagement_features, BEGIN)


def median_week1(data):
    return engagement.median_week1(data.subscriptions, data.engagement_features, BEGIN, **MARKET)


def _training(data, features_from=None):
    engagement_features, event_features = features_from or (data.engagement_features, data.event_features)
    return frames.training_frame(
        data.campaign_events, data.subscriptions, engagement_features, event_features,
        BEGIN, END, horizon=HORIZON, window_days=WINDOW, heavy=_heavy_users(data), **MARKET)


def _scoring(data, features_from=None):
    engagement_features, event_features = features_from or (data.engagement_features, data.event_features)
    return frames.scoring_frame(
        data.subscriptions, engagement_features, event_features, BEGIN, END, **MARKET)


def _bucketed_features(data):
    """Both feature tables as bucketed tables of the catalog, loaded by name."""
    loaded = []
    for table, df in (("engagement_features", data.engagement_features), ("event_features", data.event_features)):
        name = f"{table}_{uuid.uuid4().hex}"
        bucketed.write_bucketed(df, name, BUCKETS, path=_folder(data.spark, name))
        loaded.append(tables.load(data.spark, table, name=name))
    return loaded


def training_frame(data, features_from=None):
    groups = [f"experiment_group_{group}" for group in frames.GROUPS]
    part = frames.feature_part(
        _training(data, features_from), ["experiment_group", "discount_redeemed", *groups])
    return part.withColumn(
        "split", F.when(F.col("signup_date") <= F.lit(TRAIN_END), "train").otherwise("test"))


def scoring_frame(data, features_from=None):
    return frames.feature_part(_scoring(data, features_from))


def training_frame_bucketed(data):
    return training_frame(data, _bucketed_features(data))


def scoring_frame_bucketed(data):
    return scoring_frame(data, _bucketed_features(data))


# ---- bins and distributions ------------------------------------------------

def _tr_scores(data):
    return data.pseudo_scores


def quantile_bins(data):
    scores = _scores_with_uplift(data)
    return binning.quantile_bins(scores, "uplift_score", 10).select(
        "hs_user_id", "subscription_id", "uplift_score", "bin")


def quantile_bins_falling(data):
    scores = _scores_with_uplift(data)
    return binning.quantile_bins(scores, "uplift_score", 5, falling=True).select(
        "hs_user_id", "subscription_id", "uplift_score", "bin")


def equal_width_bins(data):
    scores = _scores_with_uplift(data)
    return binning.equal_width_bins(scores, "uplift_score", 5).select(
        "hs_user_id", "subscription_id", "uplift_score", "bin")


def _responders(data):
    """Both kinds of responders, marked."""
    lapsed = _lapsed(data)
    control = winback.control_responders(lapsed).withColumn("arm", F.lit("control"))
    treated = winback.treatment_responders(lapsed).withColumn("arm", F.lit("treatment"))
    return control.unionByName(treated, allowMissingColumns=True)


def histogram_density(data):
    """Tenure at cancellation in 28-day bars, by arm, for yearly plans."""
    yearly = _responders(data).filter(F.col("plan_initial_term_months") == 12)
    return binning.density_histogram(yearly, "tenure_at_cancellation", 28, "arm")


def histogram_return_delay(data):
    """Days until return in 3-day bars, by arm."""
    later = _responders(data).filter(
        F.col("days_until_return__from_previous_subscription_end_date") > 0)
    return binning.density_histogram(
        later, "days_until_return__from_previous_subscription_end_date", 3, "arm")


def histogram_return_window(data):
    """Tenure of treated users back within 35 days against later ones."""
    treated = winback.treatment_responders(_lapsed(data)).withColumn(
        "back_within_35", F.col("days_until_return__from_previous_subscription_end_date") <= 35)
    return binning.density_histogram(treated, "tenure_at_cancellation", 28, "back_within_35")


def histogram_density_monthly(data):
    """Tenure at cancellation in 28-day bars, by arm, for monthly plans."""
    monthly = _responders(data).filter(F.col("plan_initial_term_months") == 1)
    return binning.density_histogram(monthly, "tenure_at_cancellation", 28, "arm")


def histogram_return_window_monthly(data):
    """Tenure of treated users of monthly plans back within 35 days against later ones."""
    treated = winback.treatment_responders(_lapsed(data)).filter(
        F.col("plan_initial_term_months") == 1
    ).withColumn(
        "back_within_35", F.col("days_until_return__from_previous_subscription_end_date") <= 35)
    return binning.density_histogram(treated, "tenure_at_cancellation", 28, "back_within_35")


def histogram_email_return_delay(data):
    """Days from first email to return in 3-day bars, by arm."""
    email = "days_until_return__from_first_email_date"
    return binning.density_histogram(_responders(data).filter(F.col(email) > 0), email, 3, "arm")


def tenure_return_pairs_monthly(data):
    """Tenure and days until return of treated users of monthly plans."""
    treated = winback.treatment_responders(_lapsed(data)).filter(
        (F.col("tenure_at_cancellation") > 0) & (F.col("plan_initial_term_months") == 1))
    return binning.value_pairs(treated, "tenure_at_cancellation",
                               "days_until_return__from_previous_subscription_end_date")


def histogram_shared_edges(data):
    return binning.shared_edge_histogram(
        _stored(takerate.within_year(_conversions(data))), "days_since_cancel", 50,
        "convert_28day_ind")


def score_histogram(data):
    everyone = _tr_scores(data).withColumn("group", F.lit("all"))
    return binning.shared_edge_histogram(everyone, "propensity_TR", 10, "group")


def kernel_density(data):
    density = binning.kernel_density(
        _responders(data), "days_until_return__from_previous_subscription_end_date", "arm")
    return _rounded(density, "x", "density")


def box_summary(data):
    """Days from first email to return, per tenth of the days to that email."""
    email = "days_until_email__from_subscription_end_date"
    treated = _stored(winback.treatment_responders(_lapsed(data)))
    edges = binning.quantile_edges(treated, email, 10, "drop")
    binned = treated.withColumn("bin", binning.assign_bins(email, edges)).filter(F.col(email) > 0)
    return binning.box_summary(binned, "bin", "days_until_return__from_first_email_date")


def email_delay_mean(data):
    treated = winback.treatment_responders(_lapsed(data))
    email = "days_until_email__from_subscription_end_date"
    return treated.agg(F.avg(email).alias("mean_days_until_email"))


def tenure_return_pairs(data):
    treated = winback.treatment_responders(_lapsed(data)).filter(
        F.col("tenure_at_cancellation") > 0)
    return binning.value_pairs(treated, "tenure_at_cancellation",
                               "days_until_return__from_previous_subscription_end_date")


def email_delay_steps(data):
    treated = winback.treatment_responders(_lapsed(data))
    step = binning.floor_to_step("days_until_email__from_subscription_end_date", 5)
    return treated.groupBy(step.alias("days_from")).count()


# ---- scores, tracking, export ----------------------------------------------

def _scores_with_uplift(data):
    return uplift.add_uplift(data.pseudo_scores)


def _score_table(data):
    binned = binning.quantile_bins(
        _scores_with_uplift(data), "uplift_score", 10, "uplift_score_bin")
    return binned.withColumn("run_date", F.lit(RUN_DATE)).select(*export.SCORE_COLUMNS)


def scores(data):
    return _score_table(data)


def tracking_by_bin(data):
    return tracking.events_by_uplift_bin(
        data.campaign_events, _score_table(data), name_pattern=campaigns.DROPOUT_NAMES)


def high_uplift_signups(data):
    return tracking.high_uplift_signups(_score_table(data))


def latest_score(data):
    return export.latest_scores(_score_table(data))


def row_numbers(data):
    ids = data.subscriptions.select("hs_user_id", "subscription_id")
    return number_rows(ids, "hs_user_id", "subscription_id")[0]


def payload_batches(data):
    """Per request: how many users, who, and a check sum of what is sent."""
    batches = export.payload_batches(_score_table(data))
    users = F.col("batch_request_payload")
    return batches.select(
        "batch_request_num",
        F.size(users).alias("users"),
        F.concat_ws(",", F.array_sort(F.transform(users, lambda u: u["external_id"]))).alias("ids"),
        F.aggregate(users, F.lit(0), lambda total, u: total + u["uplift_score_bin"]).alias("bin_sum"))


def score_generations(data):
    """Scores appended in three parts, each with more columns, read by name; then one year replaced."""
    path = _folder(data.spark, "scores")
    table, third = _score_table(data), F.pmod("hs_user_id", F.lit(3))
    late = ["run_date", "uplift_score_bin"]
    for turn in range(3):
        export.write_scores(table.filter(third == turn).drop(*late[turn:]), path)
    again = F.year("signup_date") == 1997
    export.write_scores(table.filter(again & (third == 0)), path, replace_dates=True)
    stored = data.spark.read.option("mergeSchema", "true").parquet(path)
    return stored.groupBy(F.year("signup_date").alias("year")).agg(
        F.count("*").alias("rows"), F.count("run_date").alias("dated"),
        F.count("uplift_score_bin").alias("binned"), F.countDistinct("signup_date").alias("dates"))


def delivered_batches(data):
    """The ledger after two deliveries of the same batches, of which the second sends nothing."""
    batches = _stored(export.payload_batches(_score_table(data)))
    ledger = _folder(data.spark, "ledger")
    for _ in range(2):
        delivery.deliver(batches, lambda key, users: None, ledger, "first")
    keys = delivery.with_keys(batches, "first").select("batch_key", "batch_request_num")
    return delivery.acknowledged(data.spark, ledger).join(keys, "batch_key").select("batch_request_num", "users")


# ---- model and evaluation --------------------------------------------------

def _labelled_scores(data):
    """Pseudo-scores with an outcome: whether the subscription was ever paid."""
    outcome = data.subscriptions.select(
        "subscription_id",
        F.col("paid_subscription_start_date").isNotNull().cast("int").alias("label"))
    return data.pseudo_scores.join(outcome, "subscription_id")


def classification_report(data):
    return evaluation.classification_report(_labelled_scores(data), "label", "propensity_TR")


def threshold_curve(data):
    curve = evaluation.threshold_curve(_labelled_scores(data), "label", "propensity_TR")
    return curve.select("threshold", "tp", "fp", "precision", "recall", "fpr", "tpr")


def curve_areas(data):
    curve = evaluation.threshold_curve(_labelled_scores(data), "label", "propensity_TR")
    return _rounded(evaluation.areas(curve), "roc_auc", "pr_auc")


def calibration_table(data):
    return _rounded(
        evaluation.calibration_table(_labelled_scores(data), "label", "propensity_TR"),
        "mean_score", "actual_rate")


def sigmoid_calibration(data):
    """Sigmoids of the outcome over both pseudo-scores, in four folds each."""
    scored = _labelled_scores(data).select(
        F.pmod("subscription_id", F.lit(4)).cast("int").alias("fold"), "label",
        F.explode(F.create_map(F.lit("TR"), "propensity_TR", F.lit("CR"), "propensity_CR")).alias("arm", "score"))
    fitted = calibration.sigmoid_table(_stored(scored), "label", "score", ["arm", "fold"])
    return _rounded(fitted, "slope", "intercept")


PAID_NUMBERS = ["free_trial_days", "renewal_count", "week1_events"]
PAID_LABELS = ["experiment_group", "experiment_group_TR", "experiment_group_CR"]


def _paid_frame(data):
    """Every subscription as a labelled user: paid or not, in two arms.

    Larger than the users of the drop-out experiment, so that models can be
    fitted on every test folder.
    """
    key = F.col("subscription_id")
    paid = F.col("paid_subscription_start_date").isNotNull()
    treated = F.pmod(F.floor(key / 2), F.lit(2)) == 0
    group = F.concat(F.when(treated, "T").otherwise("C"), F.when(paid, "R").otherwise("N"))
    described = data.subscriptions.select(
        "hs_user_id", F.col("dt").alias("signup_date"), "subscription_id", group.alias("experiment_group"),
        plan_length("plan_renewal_term_months").alias("plan_renewal_term_months_c"), "subscription_platform",
        subscriber_kind("renewal_count").alias("renewal_c"), "free_trial_days", "renewal_count",
        F.pmod(key * 53, F.lit(97)).alias("week1_events"))
    return described.withColumns({
        f"experiment_group_{g}": (F.col("experiment_group") == g).cast("int") for g in ("TR", "CR")})


def prepared_features(data):
    """What the feature preparation must keep: slots, scales, variances and products."""
    frame = _stored(_paid_frame(data))
    fitted = uplift.preparation(features.feature_columns(frame.columns)).fit(frame)
    ready = _stored(fitted.transform(frame).select(*[
        vector_to_array(c).alias(c) for c in
        (*[f"_{c}_slots" for c in features.CATEGORIES], "_scaled", "_components", "_joined", uplift.FEATURES)]))
    labels_of = dict(zip(sorted(features.CATEGORIES), fitted.stages[0].labelsArray))
    slots = {f"{c}={value}": F.sum(F.col(f"_{c}_slots")[k])
             for c in features.CATEGORIES for k, value in enumerate(labels_of[c])}
    scaled = {c: F.sum(F.col("_scaled")[k] * F.col("_scaled")[k]) for k, c in enumerate(sorted(PAID_NUMBERS))}
    part = [F.col("_components")[k] for k in range(len(PAID_NUMBERS))]
    total = lambda c, f: F.aggregate(c, F.lit(0.0), lambda t, x: t + f(x))
    s, q = total("_joined", lambda x: x), total("_joined", lambda x: x * x)
    products = F.abs(total(uplift.FEATURES, lambda x: x) - ((s * s + q) / 2 + s)) < 1e-6
    measures = {
        **{("slots", k): v for k, v in slots.items()}, **{("scaled", k): v for k, v in scaled.items()},
        ("components", "trace"): sum(F.var_samp(c) for c in part),
        ("components", "largest covariance"): F.greatest(*[
            F.abs(F.covar_samp(a, b)) for k, a in enumerate(part) for b in part[:k]]),
        ("products", "width"): F.max(F.size(uplift.FEATURES)),
        ("products", "rows that add up"): F.count(F.when(products, 1)),
    }
    rows = ready.agg(F.array(*[
        F.struct(F.lit(a).alias("part"), F.lit(b).alias("name"), v.cast("double").alias("value"))
        for (a, b), v in measures.items()]).alias("rows"))
    return _rounded(rows.select(F.inline("rows")), "value")


def fold_sizes(data):
    """Users per arm, fold and outcome."""
    sizes = []
    for arm, frame in zip(("TR", "CR"), frames.split_by_arm(_paid_frame(data))):
        label = f"experiment_group_{arm}"
        ready = frame.select(*frames.KEYS, F.lit(0).alias(uplift.FEATURES), F.col(label).cast("double"))
        dealt = uplift._in_folds(ready, label, uplift.PRODUCTION.folds, uplift.PRODUCTION.fit_tasks, frames.KEYS)
        sizes.append(dealt.groupBy(F.lit(arm).alias("arm"), F.col("_fold").alias("fold"),
                                   F.col(label).cast("int").alias("responded")).count())
    return sizes[0].unionByName(sizes[1])


def oversampled_counts(data):
    """Classes of the treatment arm after oversampling, and the ranges they stay in."""
    treatment, _ = frames.split_by_arm(_paid_frame(data))
    filled = oversampling.oversample(
        treatment, "experiment_group_TR", PAID_NUMBERS, features.CATEGORIES)
    return filled.groupBy("experiment_group_TR").agg(
        F.count("*").alias("rows"), *[F.countDistinct(c).alias(f"values_of_{c}") for c in features.CATEGORIES],
        *[f(c).cast("bigint").alias(f"{n}_{c}") for c in PAID_NUMBERS for n, f in (("low", F.min), ("high", F.max))])


# Small forests: what is checked holds for every size.
SMALL_FORESTS = uplift.ForestSettings(trees=6, folds=3, max_depth=5)


def uplift_identities(data):
    """How many scored users keep what must hold for every score."""
    frame = _stored(_paid_frame(data).select(
        *frames.KEYS, *PAID_LABELS, *features.CATEGORIES, *PAID_NUMBERS))
    scored = uplift.score_users(frame, *uplift.fit_both_arms(frame, SMALL_FORESTS))
    binned = uplift.bin_scores(scored, q=5, duplicates="drop")
    tr, cr = F.col("propensity_TR"), F.col("propensity_CR")
    near = lambda a, b: F.count(F.when(F.abs(a - b) < 1e-12, 1))
    return uplift.score_table(binned, RUN_DATE).groupBy(F.substring("signup_date", 1, 4).alias("year")).agg(
        F.count("*").alias("users"),
        F.count(F.when(tr.between(0, 1) & cr.between(0, 1), 1)).alias("propensities"),
        near(F.col("propensity_TN"), 1 - tr).alias("opposite_tr"),
        near(F.col("propensity_CN"), 1 - cr).alias("opposite_cr"),
        near(F.col("uplift_score"), 2 * (tr - cr)).alias("uplifts"),
        F.count("uplift_score_bin").alias("binned"), F.max("run_date").alias("run_date"))


SCORING_DATE = dt.date(2000, 6, 30)


def date_split(data):
    """Labelled users per window of a scoring run, arm and outcome."""
    windows = windows_for(SCORING_DATE, HORIZON)
    parts = zip(("train", "test", "final"), frames.split_by_date(
        _training(data), windows.train_end, windows.test_end))
    counted = [
        users.groupBy(F.lit(part).alias("part"), F.lit(arm).alias("arm"), "experiment_group").agg(
            F.count("*").alias("users"), F.min("signup_date").alias("first"), F.max("signup_date").alias("last"))
        for part, frame in parts for arm, users in zip(("treatment", "control"), frames.split_by_arm(frame))]
    return reduce(DataFrame.unionByName, counted)


def weeks_2_to_4(data):
    """Campaign events of a user in the first four weeks of each month."""
    day = F.dayofmonth("dt") - 1
    daily = data.campaign_events.filter(day < 28).groupBy(
        F.col("external_user_id").alias("hs_user_id"), F.trunc("dt", "MM").alias("signup_date")).agg(*[
            F.count(F.when(day == k, 1)).alias(f"day{k}_events") for k in range(28)])
    weekly = daily.select("*", *[features.week_sum("events", week) for week in range(1, 5)])
    return weekly.select(*frames.KEYS, *[f"week{w}_events" for w in range(1, 5)], features.weeks_2_to_4("events"))


NEIGHBOUR_NUMBERS = ["week1_content_starts", "week1_returns", "renewal_count", "free_trial_days"]
NEIGHBOUR_APART = 50.0


def feature_neighbours(data):
    """Squared distances from each distinct user profile to its five nearest."""
    profiles = _scoring(data).select(
        *[F.col(c).cast("double").alias(c) for c in NEIGHBOUR_NUMBERS], *features.CATEGORIES)
    points = profiles.groupBy(*profiles.columns).agg(F.count("*").alias("copies"))
    placed, near = oversampling.nearest_neighbours(
        points, NEIGHBOUR_NUMBERS, features.CATEGORIES, NEIGHBOUR_APART)
    take = F.least(F.col("copies"), 5 - (F.col("upto") - F.col("copies"))).cast("int")
    distances = near.groupBy("point").agg(F.sort_array(F.flatten(F.collect_list(
        F.array_repeat("distance", take)))).alias("d"))
    return placed.join(distances, "point").select(
        *profiles.columns, "copies", *[F.get("d", F.lit(i)).alias(f"d{i + 1}") for i in range(5)])


def oversampled_training(data):
    """The labelled treatment users, filled up to equal classes."""
    treatment, _ = frames.split_by_arm(_training(data))
    numbers = [c for c in features.feature_columns(treatment.columns)
               if c not in features.CATEGORIES]
    return oversampling.oversample(
        treatment, "experiment_group_TR", numbers, features.CATEGORIES)


def uplift_scores(data):
    """Train both arms on all labelled users, score everyone, bin and date."""
    labelled = frames.feature_part(
        _training(data), ["experiment_group", "experiment_group_TR", "experiment_group_CR"])
    treatment, control = uplift.fit_both_arms(labelled)
    scored = uplift.score_users(frames.feature_part(_scoring(data)), treatment, control)
    return uplift.score_table(uplift.bin_scores(scored), RUN_DATE)


ALL = [
    user_cohort, latest_date, available_dates, engagement_feature_range, event_feature_range,
    user_history, campaign_rollup_dropout, campaign_rollup_by_id, campaign_rollup_winback,
    campaign_rollup_group, variation_counts, events_by_variation, forward_interval_nearest,
    backward_nearest, validity_interval_join, next_subscription, experiment_labels,
    experiment_labels_by_campaign, winback_target, winback_responders_control,
    winback_responders_treatment, returns_by_voucher, take_rate_treatment,
    take_rate_treatment_equal_width, take_rate_treatment_users, take_rate_control_curve,
    take_rate_control, take_rate_control_equal_width, take_rate_10day_treatment,
    take_rate_10day_control, campaign_funnel, daily_features_week1, feature_trends,
    median_daily_total, median_week1, training_frame, scoring_frame, quantile_bins,
    quantile_bins_falling, equal_width_bins, histogram_density, histogram_return_delay,
    histogram_return_window, histogram_density_monthly, histogram_return_window_monthly,
    histogram_email_return_delay, tenure_return_pairs_monthly, histogram_shared_edges, score_histogram, kernel_density, box_summary,
    email_delay_mean, tenure_return_pairs, email_delay_steps, scores, tracking_by_bin,
    high_uplift_signups, latest_score, row_numbers, payload_batches, score_generations,
    delivered_batches, classification_report,
    threshold_curve, curve_areas, calibration_table, sigmoid_calibration, prepared_features, fold_sizes,
    oversampled_counts, uplift_identities, date_split, weeks_2_to_4, feature_neighbours, oversampled_training,
    uplift_scores, latest_stored_date, stored_dates, training_frame_bucketed, scoring_frame_bucketed, forward_interval_nearest_heavy, next_subscription_heavy, winback_target_heavy,
]


def queries():
    def over_folder(build):
        return lambda spark, folder: build(Fixtures(spark, folder))

    return {build.__name__: over_folder(build) for build in ALL}
