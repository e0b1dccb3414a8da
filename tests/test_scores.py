"""Export, tracking, evaluation and the model."""

import json
import math
import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortlift.plans import delivery, evaluation, export, jobs, tracking, uplift
from cohortlift.sources import tables
from conftest import day, rows

SCORE = ("hs_user_id long, signup_date string, propensity_TR double, propensity_CR double,"
         " propensity_TN double, propensity_CN double, uplift_score double, uplift_score_bin int,"
         " run_date date")


def score(user, date="2022-05-31", value=.5, bin_=5, run="2022-06-07"):
    return (user, date, value, .1, 1 - value, .9, value, bin_, day(run))


@pytest.fixture(scope="module")
def scores(spark):
    return spark.createDataFrame(
        [score(user, bin_=user % 10 + 1) for user in range(1, 121)]
        + [score(7, "2022-05-30", .9, 9), score(8, value=.7, run="2022-06-08")], SCORE)


def test_newest_score(scores):
    got = {r["hs_user_id"]: r["uplift_score"] for r in export.latest_scores(scores).collect()}
    assert len(got) == 120 and got[7] == .5 and got[8] == .7
    assert [r["hs_user_id"] for r in export.latest_scores(scores, "2022-05-30").collect()] == [7]


def test_batches_hold_everyone_once(scores):
    batches = export.payload_batches(scores).collect()
    sizes = [len(r["batch_request_payload"]) for r in batches]
    assert len(batches) == math.ceil(120 / 50) and max(sizes) <= 50 and max(sizes) - min(sizes) <= 1
    users = [u["external_id"] for r in batches for u in r["batch_request_payload"]]
    assert sorted(users, key=int) == [str(u) for u in range(1, 121)]
    # Users are dealt by their place in id order.
    for r in batches:
        assert {int(u["external_id"]) % 3 for u in r["batch_request_payload"]} == {r["batch_request_num"]}


def test_no_users_no_batches(scores):
    assert export.payload_batches(scores, "1999-01-01").count() == 0


def test_export_and_delivery(scores, tmp_path):
    batches = export.payload_batches(scores)
    export.export_batches(batches, str(tmp_path / "out"))
    lines = [json.loads(line) for f in (tmp_path / "out").glob("*.json") for line in f.read_text().splitlines()]
    assert sum(len(line["batch_request_payload"]) for line in lines) == 120
    assert set(lines[0]["batch_request_payload"][0]) == {"external_id", "uplift_score_bin", "uplift_score"}
    drop = str(tmp_path)

    def send(users):
        with open(f"{drop}/sent-{users[0]['external_id']}", "w") as out:
            out.write(str(len(users)))

    export.deliver(batches, send)
    assert sum(int(f.read_text()) for f in tmp_path.glob("sent-*")) == 120


def sent_to(folder, fail_after=None):
    """A receiver that files every call, and after some calls in a task answers no more."""
    calls = []

    def send(key, users):
        if fail_after is not None and len(calls) >= fail_after:
            raise ConnectionError("no answer")
        calls.append(key)
        with open(f"{folder}/{key}", "a") as out:
            out.write(f"{len(users)} ")

    return send


@pytest.fixture
def many_batches(spark, tmp_path):
    people = spark.range(1000).select(F.struct(
        F.col("id").cast("string").alias("external_id"), F.lit(3).alias("uplift_score_bin"),
        F.lit(.5).alias("uplift_score")).alias("user"), (F.col("id") % 24).alias("batch_request_num"))
    (tmp_path / "sent").mkdir()
    return people.groupBy("batch_request_num").agg(F.collect_list("user").alias("batch_request_payload"))


def test_no_batch_is_acknowledged_twice(spark, many_batches, tmp_path):
    sent, ledger = tmp_path / "sent", str(tmp_path / "ledger")
    with pytest.raises(Exception, match="no answer"):
        delivery.deliver(many_batches.repartition(2), sent_to(sent, 5), ledger)
    first = {f.name for f in sent.iterdir()}
    assert 5 <= len(first) < 24 and delivery.acknowledged(spark, ledger).count() == 0
    assert {f.name for f in (tmp_path / "ledger/notes").iterdir()} == first      # what the receiver has
    done = delivery.deliver(many_batches.repartition(3), sent_to(sent), ledger)
    for _ in range(2):      # nothing is left to send
        again = delivery.deliver(many_batches, sent_to(sent), ledger)
    calls = {f.name: f.read_text().split() for f in sent.iterdir()}
    assert len(calls) == 24 and all(len(c) == 1 for c in calls.values())
    assert sum(int(c[0]) for c in calls.values()) == 1000
    ledger_rows = again.collect()
    assert {r["batch_key"]: [str(r["users"])] for r in ledger_rows} == calls and done.count() == 24
    assert not list((tmp_path / "ledger/notes").iterdir())
    delivery.deliver(many_batches, sent_to(sent), ledger, label="next week")
    assert len(list(sent.iterdir())) == 48


def test_a_task_that_runs_again_skips_what_is_noted(spark, many_batches, tmp_path):
    sent, ledger = tmp_path / "sent", str(tmp_path / "ledger")
    delivery._Folder(ledger).make()
    rows_ = delivery.with_keys(many_batches).collect()
    writer = delivery._Writer(ledger, sent_to(sent, 10))
    with pytest.raises(ConnectionError):
        writer.write(iter(rows_))
    messages = [delivery._Writer(ledger, sent_to(sent)).write(iter(rows_)), None, writer.write(iter([]))]
    writer.commit(messages)
    assert all(f.read_text().count(" ") == 1 for f in sent.iterdir()) and len(list(sent.iterdir())) == 24
    assert delivery.acknowledged(spark, ledger).count() == 24


def test_hand_out_with_a_ledger(spark, scores, tmp_path):
    (tmp_path / "sent").mkdir()
    for _ in range(2):
        done = jobs.hand_out(scores, day("2022-05-31"), str(tmp_path / "out"), sent_to(tmp_path / "sent"),
                             str(tmp_path / "ledger"))
    assert done.count() == 3 and all(f.read_text().count(" ") == 1 for f in (tmp_path / "sent").iterdir())


def test_delivery_of_nothing_and_of_changed_batches(spark, many_batches, tmp_path):
    sent, ledger = tmp_path / "sent", str(tmp_path / "ledger")
    assert delivery.deliver(many_batches.filter("false"), sent_to(sent), ledger).count() == 0
    delivery.deliver(many_batches, sent_to(sent), ledger)
    changed = many_batches.withColumn("batch_request_payload", F.when(
        F.col("batch_request_num") == 7, F.slice("batch_request_payload", 1, 3)).otherwise(
        F.reverse("batch_request_payload")))      # another order of the same users is the same batch
    assert delivery.deliver(changed, sent_to(sent), ledger).count() == 25


def test_append_widens_and_reruns_replace(spark, scores, tmp_path):
    path = str(tmp_path / "scores")
    export.write_scores(scores.drop("run_date"), path)
    export.write_scores(scores.filter("hs_user_id < 5"), path)
    stored = tables.load(spark, "scores", path)
    assert stored.count() == scores.count() + 4
    assert stored.filter("run_date is not null").count() == 4


def test_backfill_leaves_other_dates(spark, scores, tmp_path):
    path = str(tmp_path / "scores")
    export.write_scores(scores, path)
    job = lambda date: scores.filter("hs_user_id < 11").withColumn("signup_date", F.lit(str(date)))
    for _ in range(2):
        export.backfill([day("2022-05-31"), day("2022-05-29")], job, path)
    counts = {str(r["signup_date"]): r["count"] for r in
              spark.read.parquet(path).groupBy("signup_date").count().collect()}
    # Ten users, two of them with two rows.
    assert counts == {"2022-05-31": 12, "2022-05-30": 1, "2022-05-29": 12}


def test_backfill_of_a_date_without_users_empties_it(spark, scores, tmp_path):
    path = str(tmp_path / "scores")
    export.write_scores(scores, path)
    others = scores.filter("signup_date <> '2022-05-30'").count()
    for _ in range(2):      # the second time there is nothing to remove
        export.backfill([day("2022-05-30")], lambda date: scores.filter("hs_user_id < 0"), path)
    left = spark.read.parquet(path)
    assert left.filter("signup_date = '2022-05-30'").isEmpty() and left.count() == others


@pytest.fixture
def database(spark, tmp_path):
    spark.sql(f"CREATE DATABASE kept LOCATION '{tmp_path / 'kept'}'")
    yield "kept"
    spark.sql("DROP DATABASE kept CASCADE")


def test_scores_go_to_a_table_of_the_catalog(spark, scores, database):
    for _ in range(2):
        export.append_to_table(scores, "kept.user_scores")
    stored = tables.load(spark, "scores", name="kept.user_scores")
    assert stored.count() == 2 * scores.count() and set(stored.columns) == set(scores.columns)


def test_a_table_gains_columns(spark, scores, database):
    first = scores.drop("run_date", "propensity_TN").filter("hs_user_id <= 10")
    second = scores.drop("propensity_TN").filter("hs_user_id between 11 and 20")
    third = scores.filter("hs_user_id between 21 and 30").withColumns(
        {"model.name": F.lit("b"), "parts": F.array(F.lit(1.5))})
    for part in (first, second, third, first.select(*reversed(first.columns))):
        export.append_to_table(part, "kept.user_scores")
    stored = tables.load(spark, "scores", name="kept.user_scores")
    assert stored.columns[-1] == "signup_date" and set(stored.columns) == set(third.columns)
    got = {r["g"]: tuple(r)[1:] for r in stored.groupBy(F.expr("(hs_user_id - 1) div 10").alias("g")).agg(
        F.count("*"), F.count("run_date"), F.count("propensity_TN"), F.count("`model.name`"),
        F.sum(F.col("parts")[0])).collect()}
    # Users 7 and 8 have two rows.
    assert got == {0: (24, 0, 0, 0, None), 1: (10, 10, 0, 0, None), 2: (10, 10, 10, 10, 15.0)}
    kept = scores.filter("hs_user_id between 11 and 20")
    assert rows(stored.filter("hs_user_id between 11 and 20").select(*first.columns)) == rows(kept.select(*first.columns))


def test_a_changed_type_is_refused(spark, scores, database):
    export.append_to_table(scores, "kept.user_scores")
    for changed in ("cast(uplift_score_bin as string)", "cast(uplift_score_bin as bigint)"):
        with pytest.raises(ValueError, match="uplift_score_bin"):
            export.append_to_table(scores.withColumns(
                {"uplift_score_bin": F.expr(changed), "more": F.lit(1)}), "kept.user_scores")
    stored = spark.table("kept.user_scores")
    assert stored.count() == scores.count() and "more" not in stored.columns


def test_dates_of_a_table_are_replaced(spark, scores, database):
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    export.append_to_table(scores, "kept.user_scores")
    some = scores.filter("signup_date = '2022-05-30'").withColumn("more", F.lit(1))
    for _ in range(2):
        export.append_to_table(some, "kept.user_scores", replace_dates=True)
    stored = spark.table("kept.user_scores")
    assert stored.count() == scores.count() and stored.agg(F.sum("more")).first()[0] == 1
    job = lambda date: scores.filter("hs_user_id < 11 and uplift_score_bin > 1").filter(
        F.lit(date.day) != 30).withColumn("signup_date", F.lit(str(date)))     # noqa: E731
    for _ in range(2):
        export.backfill_table([day("2022-05-30"), day("2022-06-01"), day("2022-05-30")], job, "kept.user_scores")
    counts = {r[0]: r[1] for r in spark.table("kept.user_scores").groupBy("signup_date").count().collect()}
    expected = scores.filter("hs_user_id < 11 and uplift_score_bin > 1").count()
    assert counts == {"2022-05-31": scores.count() - 1, "2022-06-01": expected}
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == mode


def test_high_uplift_signups(scores):
    got = rows(tracking.high_uplift_signups(scores), ["signup_date", "count"])
    assert got == [("2022-05-30", 1), ("2022-05-31", 60)]


@pytest.fixture(scope="module")
def labelled(spark):
    pick = random.Random(1)
    data = [(int(pick.random() < p), p) for p in (round(pick.random(), 2) for _ in range(500))]
    return spark.createDataFrame(data, "y int, p double"), data


def test_areas_against_pairs(labelled):
    df, data = labelled
    ones, zeros = [p for y, p in data if y], [p for y, p in data if not y]
    right = sum((a > b) + .5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))
    curve = evaluation.threshold_curve(df, "y", "p")
    got = evaluation.areas(curve).first()
    assert got["roc_auc"] == pytest.approx(right)
    points, hits, said = [(0.0, 1.0)], 0, 0
    for threshold in sorted({p for _, p in data}, reverse=True):
        hits += sum(y for y, p in data if p == threshold)
        said += sum(1 for _, p in data if p == threshold)
        points.append((hits / len(ones), hits / said))
    area = sum((r1 - r0) * (p1 + p0) / 2 for (r0, p0), (r1, p1) in zip(points, points[1:]))
    assert got["pr_auc"] == pytest.approx(area)
    assert curve.count() == len({p for _, p in data})


def test_report_and_calibration(labelled):
    df, data = labelled
    report = {r["class"]: r for r in evaluation.classification_report(df, "y", "p").collect()}
    said = [(y, int(p > .5)) for y, p in data]
    hit = sum(1 for y, s in said if y == s == 1)
    assert report["1"]["precision"] == pytest.approx(hit / sum(s for _, s in said))
    assert report["1"]["recall"] == pytest.approx(hit / sum(y for y, _ in said))
    assert report["accuracy"]["f1_score"] == pytest.approx(sum(y == s for y, s in said) / 500)
    assert report["0"]["support"] + report["1"]["support"] == report["macro avg"]["support"] == 500
    table = {r["bin"]: r for r in evaluation.calibration_table(df, "y", "p").collect()}
    first = [(y, p) for y, p in data if p <= .1]
    assert table[1]["rows"] == len(first)
    assert table[1]["actual_rate"] == pytest.approx(sum(y for y, _ in first) / len(first))


def test_one_class_only(spark):
    df = spark.createDataFrame([(0, .2), (0, .7)], "y int, p double")
    assert evaluation.areas(evaluation.threshold_curve(df, "y", "p")).first()["roc_auc"] == 0
    assert evaluation.classification_report(df, "y", "p").count() == 5


@pytest.fixture(scope="module")
def labelled_users(spark):
    pick = random.Random(3)
    data = []
    for user in range(240):
        plays, group = pick.randint(0, 40), ("T" if user % 2 else "C")
        hit = pick.random() < (plays / 50 if group == "T" else .3)
        name = group + ("R" if hit else "N")
        data.append((user, day("2022-01-01"), name, pick.choice(["annual", "monthly", "other"]),
                     pick.choice(["ios", "web"]), pick.choice(["new", "returning"]),
                     7, pick.choice([20, 30, 40]), pick.randint(0, 3), plays, plays // 2,
                     int(name == "TR"), int(name == "CR")))
    return spark.createDataFrame(data, (
        "hs_user_id long, signup_date date, experiment_group string, plan_renewal_term_months_c string,"
        " subscription_platform string, renewal_c string, free_trial_days int, max_discount_offered_c int,"
        " renewal_count int, week1_plays int, week1_returns int, experiment_group_TR int,"
        " experiment_group_CR int"))


QUICK = uplift.ForestSettings(trees=10, folds=3, max_depth=6)


@pytest.fixture(scope="module")
def models(labelled_users):
    return uplift.fit_both_arms(labelled_users, QUICK)


def test_scores_are_propensities(models, labelled_users):
    scored = uplift.score_users(labelled_users, *models)
    for r in scored.collect():
        assert 0 <= r["propensity_TR"] <= 1 and 0 <= r["propensity_CR"] <= 1
        assert r["propensity_TN"] == 1 - r["propensity_TR"]
        assert r["uplift_score"] == pytest.approx(2 * (r["propensity_TR"] - r["propensity_CR"]), abs=1e-12)
    treated = scored.filter("experiment_group in ('TR', 'TN')")
    rate, mean = treated.agg(F.avg("experiment_group_TR"), F.avg("propensity_TR")).first()
    assert mean == pytest.approx(rate, abs=.1)
    curve = evaluation.threshold_curve(treated, "experiment_group_TR", "propensity_TR")
    assert evaluation.areas(curve).first()["roc_auc"] > .75
    table = uplift.score_table(uplift.bin_scores(scored, duplicates="drop"), day("2022-06-07"))
    assert table.columns == export.SCORE_COLUMNS
    assert dict(table.dtypes)["signup_date"] == "string"
    rates = {r["b"]: r["p"] for r in table.groupBy(F.col("uplift_score_bin").alias("b"))
             .agg(F.avg("uplift_score").alias("p")).collect()}
    assert sorted(rates, key=rates.get) == sorted(rates)


def test_same_seed_same_scores(models, labelled_users):
    again = uplift.fit_propensity(
        labelled_users.filter("experiment_group in ('TR', 'TN')"), "experiment_group_TR", QUICK)
    first = models[0].score(labelled_users, "p").orderBy("hs_user_id").collect()
    second = again.score(labelled_users, "p").orderBy("hs_user_id").collect()
    assert [r["p"] for r in first] == pytest.approx([r["p"] for r in second], abs=1e-9)


def test_fits_do_not_depend_on_partitions(spark, labelled_users):
    arm = labelled_users.filter("experiment_group in ('TR', 'TN')")
    times = -(-60_000 // arm.count())
    many = arm.crossJoin(spark.range(times).withColumnRenamed("id", "_n")).withColumn(
        "hs_user_id", F.col("hs_user_id") * times + F.col("_n")).drop("_n")
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in ("3", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            model = uplift.fit_propensity(many, "experiment_group_TR", QUICK)
            got.append([r["p"] for r in model.score(arm, "p").orderBy("hs_user_id").collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == pytest.approx(got[1], abs=1e-9)


def test_unknown_category_is_all_zeros(models, labelled_users):
    odd = labelled_users.limit(1).withColumn("subscription_platform", F.lit("fridge"))
    slots = models[0].preparation.transform(odd).select(
        vector_to_array("_subscription_platform_slots").alias("s")).first()["s"]
    assert slots == [0.0, 0.0]


def test_numbers_are_centred_components(models, labelled_users):
    ready = models[0].preparation.transform(labelled_users.filter("experiment_group in ('TR', 'TN')"))
    centre = ready.select(vector_to_array("_components")[0].alias("c")).agg(F.avg("c")).first()[0]
    assert centre == pytest.approx(0, abs=1e-9)


def test_folds_are_stratified(labelled_users):
    ready = labelled_users.withColumn("_features", F.lit(0)).select(
        "hs_user_id", "signup_date", "_features", F.col("experiment_group_TR").cast("double"))
    sizes = uplift._in_folds(ready, "experiment_group_TR", 5, 8, uplift.KEYS).groupBy("experiment_group_TR", "_fold").count()
    for value in (0.0, 1.0):
        counts = [r["count"] for r in sizes.filter(F.col("experiment_group_TR") == value).collect()]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1


def test_too_few_of_a_class(labelled_users):
    few = labelled_users.filter("experiment_group = 'TN' or hs_user_id = 1").withColumn(
        "experiment_group_TR", (F.col("hs_user_id") == 1).cast("int"))
    with pytest.raises(ValueError, match="folds"):
        uplift.fit_propensity(few, "experiment_group_TR", QUICK)


def test_fit_on_level_classes(labelled_users):
    """Oversampling lifts the scores of the rarer class and keeps the ranking."""
    control = labelled_users.filter("experiment_group in ('CR', 'CN')")
    settings = uplift.ForestSettings(trees=5, folds=2, max_depth=4, oversampled=True)
    model = uplift.fit_propensity(control, "experiment_group_CR", settings)
    mean, rate = model.score(control, "p").agg(F.avg("p"), F.avg("experiment_group_CR")).first()
    assert rate < .4 and .4 < mean < .6


def test_grid_search_picks_from_the_grid(labelled_users):
    found = uplift.grid_search(
        labelled_users.filter("experiment_group in ('TR', 'TN')"), "experiment_group_TR",
        trees=(3, 6), depths=(2, 4), folds=2, settings=QUICK)
    assert len(found.avgMetrics) == 4 and found.bestModel.getNumTrees in (3, 6)
