"""Label rules, one edge per clause, and the four-pass form as a check."""

import pytest
from pyspark.sql import functions as F

from cohortlift.plans.labels import experiment_labels, label_groups
from cohortlift.sources.fixtures import Fixtures
from conftest import SMALL, day, plan_of, rows
from registry import queries as registered
from registry.long_forms import labels_by_group

NEAREST = (
    "hs_user_id long, dt date, canvas_variation_name string, free_trial_start_date date,"
    " free_trial_end_date date, paid_subscription_start_date date, next_voucher_code string,"
    " next_free_trial_start_date date, next_paid_subscription_start_date date,"
    " num_offers_20 long, num_offers_30 long, num_offers_40 long")


def case(user, variation="Control", trial="2022-01-01", ends="2022-01-08", paid=None,
         voucher=None, next_trial=None, next_paid=None):
    return (user, day("2022-01-01"), variation, day(trial), day(ends), day(paid), voucher,
            day(next_trial), day(next_paid), 0, 0, 0)


# user: (row, expected group or None, expected discount)
CASES = [
    (case(1), "CN", 0),
    (case(2, "Offer 40"), "TN", 0),
    (case(3, next_paid="2022-02-19"), "CR", 0),                       # day 42: still soon
    (case(4, next_paid="2022-02-20"), "CN", 0),                       # day 43: late
    (case(5, "Offer 40", next_paid="2022-02-01", voucher="SAVE20OFF"), "TR", 20),
    (case(6, "Offer 40", next_paid="2022-02-01", voucher="PARTNER"), "TR", None),
    (case(7, "Offer 40", next_paid="2022-02-01"), "TR", None),
    (case(8, next_paid="2022-02-01", voucher="x30Off"), "CR", 30),
    (case(9, paid="2022-01-08"), None, None),                         # turned paid at trial end
    (case(10, paid="2022-01-20"), "CN", 0),                           # paid later: control only
    (case(11, "Offer 40", paid="2022-01-20"), None, None),
    (case(12, next_trial="2022-01-30", next_paid="2022-02-01"), None, None),
    (case(13, next_trial="2022-01-30"), "CN", 0),                     # second trial, never paid
    (case(14, trial=None, ends=None), None, None),
    (case(15, None), None, None),                                     # null variation
    (case(16, "control"), "TN", 0),                                   # exact name only
    (case(17, ends=None), None, None),
    (case(18, voucher="5off"), "CN", 0),                              # one digit is no match
]


@pytest.fixture(scope="module")
def nearest(spark):
    return spark.createDataFrame([row for row, _, _ in CASES], NEAREST)


def test_each_clause(nearest):
    got = {r["hs_user_id"]: (r["experiment_group"], r["discount_redeemed"])
           for r in label_groups(nearest, 42).collect()}
    want = {row[0]: (group, discount) for row, group, discount in CASES if group}
    assert got == want


def test_one_pass_is_the_union_of_four(nearest):
    assert rows(label_groups(nearest, 42)) == rows(labels_by_group(nearest, 42))


EVENT = ("external_user_id long, dt date, canvas_id long, canvas_name string,"
         " canvas_variation_name string, event_name string, canvas_step_name string,"
         " in_control_group boolean")
SUB = ("hs_user_id long, subscription_id long, dt date, created_timestamp timestamp_ntz,"
       " updated_timestamp timestamp_ntz, voucher_code string, free_trial_start_date date,"
       " free_trial_end_date date, paid_subscription_start_date date,"
       " paid_subscription_end_date date")


def event(user, date, variation, name="users_canvas_entry", step="offer_40",
          canvas="A_FTDropout"):
    return (user, day(date), 1, canvas, variation, name, step, variation == "Control")


def sub(user, number, date, trial=None, ends=None, paid=None, paid_end=None, voucher=None):
    return (user, number, day(date), None, None, voucher, day(trial), day(ends), day(paid),
            day(paid_end))


def test_window_variations_and_ties(spark):
    events = spark.createDataFrame([
        # user 1 in two variations; the nearer entry wins
        event(1, "2022-01-01", "Control"), event(1, "2022-01-05", "Offer 40"),
        # user 2: no entry, a delivery only, so no entry date
        event(2, "2022-01-01", "Offer 40", "users_messages_email_delivery"),
        # user 3: two subscriptions on the same day, lower id is nearest
        event(3, "2022-01-01", "Control"),
        # user 4: subscription on the last day of the window, and one past it
        event(4, "2022-01-01", "Control"),
        # user 5: another campaign
        event(5, "2022-01-01", "Control", canvas="Winback"),
    ], EVENT)
    subs = spark.createDataFrame([
        sub(1, 1, "2022-01-06", "2022-01-06", "2022-01-13"),
        sub(2, 2, "2022-01-06", "2022-01-06", "2022-01-13"),
        sub(3, 3, "2022-01-02", "2022-01-02", "2022-01-09"),
        sub(3, 4, "2022-01-02", paid="2022-01-20", voucher="SAVE20OFF"),
        sub(4, 5, "2022-02-12", "2022-02-12", "2022-02-19"),
        sub(4, 6, "2022-02-13", paid="2022-02-20"),
        sub(5, 7, "2022-01-02", "2022-01-02", "2022-01-09"),
    ], SUB)
    args = (events, subs, day("2022-01-01"), day("2022-01-31"))
    got = {r["hs_user_id"]: (r["experiment_group"], r["discount_redeemed"], r["num_offers_40"])
           for r in experiment_labels(*args).collect()}
    # User 4's return starts outside the window and is not seen: non-responder.
    # User 1 joins twice; the second copy (Control) follows the nearest row and
    # is the same trial, which is why a next trial counts for it.
    assert got[3] == ("CR", 20, 1)
    assert got[4] == ("CN", 0, 1)
    assert got[1][0] == "TN"
    assert 2 not in got and 5 not in got
    assert rows(experiment_labels(*args, heavy=[1, 3, 4])) == rows(experiment_labels(*args))


def test_heavy_users_change_nothing_on_real_data(spark, monkeypatch):
    data = Fixtures(spark, SMALL)
    busiest = [r[0] for r in data.subscriptions.groupBy("hs_user_id").count()
               .orderBy(F.desc("count")).limit(40).collect()]
    for build in (registered.experiment_labels, registered.backward_nearest,
                  registered.winback_target, registered.validity_interval_join,
                  registered.next_subscription, registered.campaign_funnel):
        plain = rows(build(data))
        monkeypatch.setattr(registered, "_heavy_users", lambda _: busiest)
        heavy = rows(build(data))
        monkeypatch.undo()
        assert heavy == plain, build.__name__


def test_plan_limits_early_and_reads_few_columns(spark):
    plan = plan_of(registered.experiment_labels(Fixtures(spark, SMALL)))
    assert "WindowGroupLimit" in plan
    assert "l_extendedprice" not in plan and "o_totalprice" not in plan
