"""DuckDB SQL for the registered queries, in the plain long form.

Each statement starts from the test tables, derives the inputs by the rules of
FIXTURES.md and computes the answer the direct way: one row per pair, per day
or per user and day, where the Spark query takes a shorter road.
"""

from __future__ import annotations

FAR = "DATE '9999-12-31'"

# ---- derived inputs --------------------------------------------------------

SUBS = """
numbered_orders AS (
  SELECT o_custkey, o_orderkey AS k, o_orderdate AS ts, o_orderdate::DATE AS d,
         o_orderstatus, c_nationkey,
         CASE WHEN o_orderpriority IN ('1-URGENT', '3-MEDIUM') THEN 7
              WHEN o_orderpriority = '5-LOW' THEN 30 ELSE 14 END AS trial_days,
         [12, 1, 6][(o_orderkey % 3 + 1)::INTEGER]::INTEGER AS term
  FROM orders JOIN customer ON o_custkey = c_custkey
),
dated_orders AS (
  SELECT *, CASE WHEN k % 2 = 1 THEN d
                 WHEN o_orderstatus <> 'F' THEN d + trial_days END AS paid_from
  FROM numbered_orders
),
subs AS (
  SELECT o_custkey AS hs_user_id, k AS subscription_id, d AS dt,
         ts AS created_timestamp, ts AS updated_timestamp,
         CASE WHEN k % 10 < 9 THEN 'B2C' ELSE 'B2B' END AS subscription_type,
         CASE WHEN c_nationkey < 20 THEN 'US' ELSE 'CA' END AS country_code,
         trial_days AS free_trial_days,
         CASE WHEN k % 2 = 0 THEN d END AS free_trial_start_date,
         CASE WHEN k % 2 = 0 THEN d + trial_days END AS free_trial_end_date,
         paid_from AS paid_subscription_start_date,
         paid_from + (CASE term WHEN 12 THEN 365 ELSE 30 * term END)::INTEGER
           AS paid_subscription_end_date,
         term AS plan_initial_term_months, term AS plan_renewal_term_months,
         (k % 4)::INTEGER AS renewal_count,
         ['ios', 'android', 'web'][(k % 3 + 1)::INTEGER] AS subscription_platform,
         ['SAVE20OFF', 'Winback30off', 'FT40OFF', 'PARTNER', NULL][(k % 5 + 1)::INTEGER]
           AS voucher_code
  FROM dated_orders
)"""

EVENTS = """
ev AS (
  SELECT o_custkey AS external_user_id, l_shipdate::DATE AS dt, l_suppkey % 4 AS canvas_id,
         CASE WHEN l_suppkey % 2 = 0 THEN 'Email_FTDropout_v1' ELSE 'Email Winback 2021' END
           AS canvas_name,
         ['Control', 'Winback 10', 'Offer 40'][(o_custkey % 3 + 1)::INTEGER]
           AS canvas_variation_name,
         ['users_canvas_entry', 'users_messages_email_delivery', 'users_messages_email_open',
          'users_messages_email_click', 'users_canvas_conversion',
          'users_messages_email_unsubscribe', 'users_messages_webhook_send'][l_linenumber]
           AS event_name,
         CASE WHEN o_custkey % 3 = 0 THEN 'wait'
              ELSE 'offer_' || (10 + 10 * (l_partkey % 4))::VARCHAR END AS canvas_step_name,
         o_custkey % 3 = 0 AS in_control_group
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""

CANVAS = """
canvas AS (
  SELECT canvas_id AS id, canvas_name AS name, min(dt) AS created_date
  FROM ev GROUP BY canvas_id, canvas_name
)"""


def _day_columns(template: str, name: str) -> str:
    return ",\n".join(f"{template.format(day=day)} AS day{day}_{name}" for day in range(8))


ENGAGEMENT = f"""
engagement AS (
  SELECT o_custkey AS hs_user_id, o_orderdate::DATE AS signup_date,
{_day_columns("coalesce(sum(l_quantity::BIGINT) FILTER (l_linenumber = {day} + 1), 0)::BIGINT",
              "content_starts")},
{_day_columns("count(DISTINCT l_partkey) FILTER (l_linenumber = {day} + 1)", "distinct_parts")}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2
)"""

EVENT_FEATURES = f"""
event_features AS (
  SELECT o_custkey AS hs_user_id, o_orderdate::DATE AS signup_date,
{_day_columns("count(*) FILTER (l_linenumber = {day} + 1 AND l_returnflag = 'R')", "returns")}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2
)"""

PSEUDO = """
base_scores AS (
  SELECT o_custkey AS hs_user_id, o_orderkey AS subscription_id,
         strftime(o_orderdate, '%Y-%m-%d') AS signup_date,
         (o_orderkey * 37 % 1009) / 1009.0::DOUBLE AS tr,
         (o_orderkey * 53 % 997) / 997.0::DOUBLE AS cr
  FROM orders
),
pseudo AS (
  SELECT *, tr + (1 - cr) - (1 - tr) - cr AS uplift_score FROM base_scores
)"""


def _qcut(column: str, source: str, q: int, name: str = "cuts") -> str:
    """The inner and outer quantile edges as a list in one row."""
    points = ", ".join(f"{k / q!r}" for k in range(q + 1))
    return (f"{name} AS (SELECT quantile_cont({column}::DOUBLE, [{points}]::DOUBLE[]) AS e "
            f"FROM {source})")


SCORES = _qcut("uplift_score", "pseudo", 10, "score_cuts") + """,
score_table AS (
  SELECT hs_user_id, signup_date, tr AS "propensity_TR", cr AS "propensity_CR",
         1 - tr AS "propensity_TN", 1 - cr AS "propensity_CN", uplift_score,
         (1 + len(list_filter(e[2:10], lambda x: x < uplift_score)))::INTEGER AS uplift_score_bin,
         DATE '2022-06-01' AS run_date
  FROM pseudo, score_cuts
)"""

PAIR = "event_name IN ('users_canvas_entry', 'users_messages_email_delivery')"


def _offers(*sizes: int) -> str:
    return ", ".join(
        f"count(*) FILTER (canvas_step_name LIKE '%{size}%') AS num_offers_{size}"
        for size in sizes)


ENTRY = "min(dt) FILTER (event_name = 'users_canvas_entry') AS canvas_entry_date"

DROPOUT = f"""
dropout AS (
  SELECT external_user_id, canvas_variation_name, {ENTRY}, {_offers(20, 30, 40)}
  FROM ev WHERE canvas_name ILIKE '%ftdropout%' AND {PAIR} GROUP BY ALL
)"""

DROPOUT_BY_ID = f"""
dropout AS (
  SELECT external_user_id, canvas_variation_name, {ENTRY}, {_offers(20, 30, 40)}
  FROM ev WHERE canvas_id = 2 AND {PAIR} GROUP BY ALL
)"""

WINBACK_MEASURES = f"""
         min(dt) FILTER (event_name = 'users_messages_email_delivery') AS first_email_date,
         {ENTRY},
         least(min(dt) FILTER (canvas_variation_name = 'Control'
                               AND event_name = 'users_canvas_entry'),
               min(dt) FILTER (canvas_variation_name <> 'Control'
                               AND event_name = 'users_messages_email_delivery')) AS test_date,
         {_offers(10, 20, 30, 40)}"""

WINBACK = f"""
winback AS (
  SELECT external_user_id, canvas_variation_name, {WINBACK_MEASURES}
  FROM ev WHERE canvas_name ILIKE '%winback%' AND {PAIR} GROUP BY ALL
  HAVING canvas_entry_date >= DATE '1996-01-01'
)"""

WINBACK_GROUPS = f"""
winback_groups AS (
  SELECT * FROM (
    SELECT external_user_id,
           CASE WHEN canvas_variation_name = 'Control' THEN 'control' ELSE 'treatment' END
             AS experiment_group, {WINBACK_MEASURES}
    FROM ev WHERE canvas_name ILIKE '%email%winback%' AND {PAIR} GROUP BY ALL)
  WHERE experiment_group = 'control'
     OR num_offers_10 + num_offers_20 + num_offers_30 + num_offers_40 > 0
)"""

TAKEN = "dt NULLS FIRST, created_timestamp NULLS FIRST, updated_timestamp NULLS FIRST, subscription_id"

AFTER_ENTRY = f"""
after_entry AS (
  SELECT s.*, r.* EXCLUDE (external_user_id),
         lead(voucher_code) OVER later AS next_voucher_code,
         lead(free_trial_start_date) OVER later AS next_free_trial_start_date,
         lead(free_trial_end_date) OVER later AS next_free_trial_end_date,
         lead(paid_subscription_start_date) OVER later AS next_paid_subscription_start_date,
         lead(paid_subscription_end_date) OVER later AS next_paid_subscription_end_date
  FROM subs s JOIN dropout r
    ON s.hs_user_id = r.external_user_id
   AND s.dt BETWEEN r.canvas_entry_date AND r.canvas_entry_date + 365
  WINDOW later AS (PARTITION BY hs_user_id ORDER BY {TAKEN}, canvas_variation_name)
  QUALIFY row_number() OVER (PARTITION BY hs_user_id
            ORDER BY dt - canvas_entry_date, {TAKEN}, canvas_variation_name) = 1
)"""

# The four groups one after another, as separate passes over the same rows.
_WAIT = f"coalesce(next_paid_subscription_start_date, {FAR}) - free_trial_end_date"
_RULES = {
    "CN": f"canvas_variation_name = 'Control' AND {_WAIT} > 365 AND free_trial_end_date"
          f" <> coalesce(paid_subscription_start_date, {FAR})",
    "TN": f"canvas_variation_name <> 'Control' AND {_WAIT} > 365"
          " AND paid_subscription_start_date IS NULL",
    "CR": f"canvas_variation_name = 'Control' AND {_WAIT} <= 365"
          " AND paid_subscription_start_date IS NULL AND next_free_trial_start_date IS NULL",
    "TR": f"canvas_variation_name <> 'Control' AND {_WAIT} <= 365"
          " AND paid_subscription_start_date IS NULL AND next_free_trial_start_date IS NULL",
}
_DISCOUNT = "try_cast(regexp_extract(lower(next_voucher_code), '([0-9][0-9])off', 1) AS INTEGER)"
LABELS = "labels AS (" + "\n UNION ALL ".join(
    f"""SELECT hs_user_id, dt AS signup_date, '{group}' AS experiment_group,
           {_DISCOUNT if group == 'TR' else f'coalesce({_DISCOUNT}, 0)'} AS discount_redeemed,
           num_offers_20, num_offers_30, num_offers_40
    FROM after_entry WHERE free_trial_start_date IS NOT NULL AND {rule}"""
    for group, rule in _RULES.items()) + ")"

MARKET = "country_code ILIKE 'us' AND subscription_type ILIKE 'b2c'"

PAID_SEQUENCE = f"""
paid_sequence AS (
  SELECT *,
         lead(paid_subscription_start_date) OVER (PARTITION BY hs_user_id
           ORDER BY paid_subscription_start_date NULLS FIRST, subscription_id)
           AS next_paid_subscription_start_date,
         lead(voucher_code) OVER (PARTITION BY hs_user_id ORDER BY {TAKEN}) AS next_voucher_code
  FROM subs WHERE {MARKET}
)"""

LAPSED = f"""
lapsed AS (
  SELECT s.*, r.* EXCLUDE (external_user_id)
  FROM paid_sequence s JOIN winback r
    ON s.hs_user_id = r.external_user_id
   AND r.canvas_entry_date >= s.paid_subscription_end_date
  WHERE s.paid_subscription_end_date BETWEEN DATE '1996-01-01' AND DATE '2001-12-31'
    AND s.paid_subscription_end_date - s.paid_subscription_start_date >= 28
  QUALIFY row_number() OVER (PARTITION BY hs_user_id
            ORDER BY canvas_entry_date - paid_subscription_end_date, {TAKEN},
                     canvas_variation_name) = 1
)"""

_RETURNED = f"coalesce(next_paid_subscription_start_date, {FAR})"
_SEEN = "num_offers_10 + num_offers_20 + num_offers_30 + num_offers_40"
_NAMES = ("(lower(canvas_variation_name) LIKE '{0}' OR canvas_variation_name LIKE '%10%'"
          " OR canvas_variation_name LIKE '%40%')")

CONTROL_RESPONDERS = f"""
control_responders AS (
  SELECT hs_user_id, plan_initial_term_months,
         (paid_subscription_end_date - dt)::INTEGER AS tenure_at_cancellation,
         ({_RETURNED} - paid_subscription_end_date)::INTEGER
           AS days_until_return__from_previous_subscription_end_date,
         ({_RETURNED} - first_email_date)::INTEGER AS days_until_return__from_first_email_date
  FROM lapsed
  WHERE canvas_variation_name = 'Control'
    AND next_paid_subscription_start_date IS NOT NULL
    AND next_paid_subscription_start_date - paid_subscription_end_date BETWEEN 0 AND 365
)"""

TREATMENT_RESPONDERS = f"""
treatment_responders AS (
  SELECT hs_user_id, plan_initial_term_months,
         (paid_subscription_end_date - dt)::INTEGER AS tenure_at_cancellation,
         ({_RETURNED} - paid_subscription_end_date)::INTEGER
           AS days_until_return__from_previous_subscription_end_date,
         ({_RETURNED} - first_email_date)::INTEGER AS days_until_return__from_first_email_date,
         (first_email_date - paid_subscription_end_date)::INTEGER
           AS days_until_email__from_subscription_end_date
  FROM lapsed
  WHERE {_NAMES.format('winback')} AND {_SEEN} > 0
    AND {_RETURNED} - paid_subscription_end_date BETWEEN 0 AND 365
)"""

TREATED = f"""
treated AS (
  SELECT hs_user_id, paid_subscription_end_date, next_paid_subscription_start_date,
         voucher_code, next_voucher_code, first_email_date,
         (first_email_date - paid_subscription_end_date)::INTEGER AS days_since_cancel,
         CASE WHEN coalesce(next_voucher_code, 'none') ILIKE '%winback%'
               AND {_RETURNED} - first_email_date <= 28 THEN 1 ELSE 0 END AS convert_28day_ind
  FROM lapsed
  WHERE {_NAMES.format('%winback%')} AND {_SEEN} > 0
    AND {_RETURNED} >= paid_subscription_end_date
),
treated_year AS (SELECT * FROM treated WHERE days_since_cancel BETWEEN 0 AND 365)"""

# Every held-out user on every day of the year after lapsing.
HELD_OUT = f"""
held_out AS (
  SELECT hs_user_id, day::INTEGER AS days_since_cancel,
         CASE WHEN {_RETURNED} - (paid_subscription_end_date + day::INTEGER) <= 28
              THEN 1 ELSE 0 END AS convert_28day_ind
  FROM lapsed, range(1, 366) AS calendar(day)
  WHERE canvas_variation_name ILIKE '%control%' AND {_SEEN} = 0
    AND {_RETURNED} >= paid_subscription_end_date
)"""

RESPONDERS = """
responders AS (
  SELECT *, NULL::INTEGER AS days_until_email__from_subscription_end_date, 'control' AS arm
  FROM control_responders
  UNION ALL
  SELECT *, 'treatment' AS arm FROM treatment_responders
)"""

SEQUENCE = """
sequence AS (
  SELECT hs_user_id, subscription_id, dt AS subscription_start_date,
         lead(dt) OVER later AS next_subscription_start_date,
         lead(paid_subscription_start_date) OVER later AS next_paid_subscription_start_date
  FROM subs
  WINDOW later AS (PARTITION BY hs_user_id ORDER BY dt, subscription_id)
)"""

WEEK1 = "(" + " + ".join("day{0}_{{0}}".format(day) for day in range(7)) + ")"
EIGHT_DAYS = " + ".join(f"coalesce(day{day}_content_starts, 0)" for day in range(8))

COHORT = f"""
cohort AS (
  SELECT *, dt AS signup_date, date_trunc('month', dt)::DATE AS signup_month
  FROM subs WHERE {MARKET} AND free_trial_start_date IS NOT NULL
)"""

_CATEGORIES = """
         CASE plan_renewal_term_months WHEN 1 THEN 'monthly' WHEN 12 THEN 'annual'
              ELSE 'other' END AS plan_renewal_term_months_c,
         CASE WHEN renewal_count > 0 THEN 'returning' ELSE 'new' END AS renewal_c,
         renewal_count, coalesce(subscription_platform, '0') AS subscription_platform,
         coalesce(""" + WEEK1.format("content_starts") + """, 0)::BIGINT AS week1_content_starts,
         coalesce(""" + WEEK1.format("returns") + """, 0)::BIGINT AS week1_returns"""
_FEATURE_JOINS = """
  LEFT JOIN engagement USING (hs_user_id, signup_date)
  LEFT JOIN event_features USING (hs_user_id, signup_date)"""

LABELLED_SCORES = """
labelled AS (
  SELECT tr AS score, (paid_subscription_start_date IS NOT NULL)::INTEGER AS label
  FROM pseudo JOIN subs USING (subscription_id)
)"""


def _bin(value: str, edges: str, last: int) -> str:
    """Right-closed bin by the list of edges in column ``e``."""
    return f"(1 + len(list_filter({edges}[2:{last}], lambda x: x < {value})))::INTEGER"


def _statement(*parts: str) -> str:
    *inputs, final = parts
    return ("WITH " + ",".join(inputs) + "\n" + final) if inputs else final


WINBACK_CHAIN = (SUBS, EVENTS, WINBACK, PAID_SEQUENCE, LAPSED)
LABEL_CHAIN = (SUBS, EVENTS, DROPOUT, AFTER_ENTRY, LABELS)


def _funnel() -> str:
    measures = {
        "canvas_entries": "users_canvas_entry",
        "emails_delivered": "users_messages_email_delivery",
        "emails_opened": "users_messages_email_open",
        "emails_clicked": "users_messages_email_click",
        "emails_unsubscribed": "users_messages_email_unsubscribe",
        "emails_marked_as_spam": "users_messages_email_mark_as_spam",
        "webhook_sent": "users_messages_webhook_send",
        "canvas_conversion": "users_canvas_conversion",
    }
    columns = []
    for arm, test in (("treatment", "<>"), ("control", "=")):
        in_arm = f"lower(c.canvas_variation_name) {test} 'control'"
        columns += [f"count(*) FILTER ({in_arm} AND e.event_name = '{event}') AS {arm}_{name}"
                    for name, event in measures.items()]
        columns.append(
            f"count(DISTINCT c.hs_user_id) FILTER ({in_arm}"
            f" AND {_RETURNED} - c.canvas_entry_date <= 28) AS {arm}_conversions")
    return _statement(SUBS, EVENTS, CANVAS, SEQUENCE, f"""
entries AS (
  SELECT s.hs_user_id, e.dt AS canvas_entry_date, e.canvas_id, e.canvas_name,
         e.canvas_variation_name, c.created_date, s.next_paid_subscription_start_date
  FROM ev e JOIN canvas c ON e.canvas_id = c.id
  JOIN sequence s ON s.hs_user_id = e.external_user_id
   AND e.dt >= s.subscription_start_date
   AND e.dt <= coalesce(s.next_subscription_start_date, {FAR})
  WHERE e.event_name = 'users_canvas_entry' AND c.name ILIKE '%winback%'
)""", f"""
SELECT c.canvas_name, c.created_date AS canvas_created_date, {", ".join(columns)}
FROM entries c JOIN ev e ON c.hs_user_id = e.external_user_id AND c.canvas_id = e.canvas_id
GROUP BY 1, 2""")


def _histogram(source: str, column: str, group: str, width: int) -> str:
    return f"""
spans AS (
  SELECT {group}, min({column}) AS low, max({column}) AS high, count({column}) AS n
  FROM {source} GROUP BY ALL
)
SELECT {group}, bar, (low + bar * {width})::DOUBLE AS lower, count(*) AS count,
       count(*) / (n * {width})::DOUBLE AS density
FROM (
  SELECT {group}, low, n,
         least((({column} - low) // {width}),
               greatest(ceil((high - low) / {width}.0) - 1, 0))::BIGINT AS bar
  FROM {source} JOIN spans USING ({group}) WHERE {column} IS NOT NULL
) GROUP BY {group}, bar, low, n"""


def _plain(df_columns: str, *chain: str) -> str:
    return _statement(*chain, df_columns)


def _with_tail(chain: tuple[str, ...], tail: str) -> str:
    """Chain followed by a text that goes on with more inputs."""
    return "WITH " + ",".join(chain) + "," + tail


PAID = """
paid AS (
  SELECT hs_user_id, dt AS signup_date,
         CASE WHEN subscription_id // 2 % 2 = 0 THEN 'T' ELSE 'C' END
           || CASE WHEN paid_subscription_start_date IS NOT NULL THEN 'R' ELSE 'N' END AS experiment_group,
         CASE plan_renewal_term_months WHEN 1 THEN 'monthly' WHEN 12 THEN 'annual' ELSE 'other' END
           AS plan_renewal_term_months_c,
         subscription_platform, CASE WHEN renewal_count = 0 THEN 'new' ELSE 'returning' END AS renewal_c,
         free_trial_days, renewal_count, subscription_id * 53 % 97 AS week1_events
  FROM subs
)"""

# Sample deviation 1 gives n - 1 as the sum of squares; components keep the total variance.
_PREPARED = """
slots AS (
  SELECT 'plan_renewal_term_months_c=' || plan_renewal_term_months_c AS name FROM paid
  UNION ALL SELECT 'subscription_platform=' || subscription_platform FROM paid
  UNION ALL SELECT 'renewal_c=' || renewal_c FROM paid),
counted AS (SELECT name, count(*)::DOUBLE AS value FROM slots GROUP BY name),
wide AS (SELECT count(*) + 3 AS d FROM counted)
SELECT 'slots' AS part, name, value FROM counted
UNION ALL SELECT 'scaled', name, (SELECT count(*) - 1 FROM paid)::DOUBLE
FROM (VALUES ('free_trial_days'), ('renewal_count'), ('week1_events')) AS numbers(name)
UNION ALL SELECT 'components', 'trace', 3.0
UNION ALL SELECT 'components', 'largest covariance', 0.0
UNION ALL SELECT 'products', 'width', (d * (d + 3) / 2)::DOUBLE FROM wide
UNION ALL SELECT 'products', 'rows that add up', count(*)::DOUBLE FROM paid"""


def _sigmoids(steps: int = 12) -> str:
    """Newton's steps from the class sizes, one relation per step."""
    parts = ["""
pairs AS (
  SELECT arm, fold, x, CASE WHEN label = 1 THEN (p + 1) / (p + 2) ELSE 1 / (n + 2) END AS t, p, n
  FROM (
    SELECT *, sum(label) OVER (PARTITION BY arm, fold)::DOUBLE AS p,
           sum(1 - label) OVER (PARTITION BY arm, fold)::DOUBLE AS n
    FROM (
      SELECT a.arm, (subscription_id % 4)::INTEGER AS fold, CASE a.arm WHEN 'TR' THEN tr ELSE cr END AS x,
             (paid_subscription_start_date IS NOT NULL)::INTEGER AS label
      FROM pseudo JOIN subs USING (subscription_id), (VALUES ('TR'), ('CR')) AS a(arm))))""", """
s0 AS (SELECT arm, fold, 0.0::DOUBLE AS a, ln((max(p) + 1) / (max(n) + 1)) AS b FROM pairs GROUP BY arm, fold)"""]
    for k in range(steps):
        parts.append(f"""
q{k} AS (SELECT arm, fold, x, t, a, b, 1 / (1 + exp(-(a * x + b))) AS f FROM pairs JOIN s{k} USING (arm, fold)),
g{k} AS (
  SELECT arm, fold, a, b, sum((f - t) * x) AS g1, sum(f - t) AS g0, sum(f * (1 - f) * x * x) AS h11,
         sum(f * (1 - f) * x) AS h10, sum(f * (1 - f)) AS h00 FROM q{k} GROUP BY arm, fold, a, b),
s{k + 1} AS MATERIALIZED (
  SELECT arm, fold, a - (h00 * g1 - h10 * g0) / (h11 * h00 - h10 * h10) AS a,
         b - (h11 * g0 - h10 * g1) / (h11 * h00 - h10 * h10) AS b FROM g{k}),""".rstrip(","))
    return ",".join(parts) + f"""
SELECT arm, fold, round(a, 6) AS slope, round(b, 6) AS intercept, positives, negatives
FROM s{steps} JOIN (SELECT arm, fold, max(p)::BIGINT AS positives, max(n)::BIGINT AS negatives
                    FROM pairs GROUP BY arm, fold) USING (arm, fold)"""


def oracle_sql() -> dict[str, str]:
    year_bins = _qcut("days_since_cancel", "treated_year", 8)
    sql = {
        "user_cohort": _plain("SELECT * FROM cohort", SUBS, COHORT),
        "latest_date": _plain(
            "SELECT max(signup_date) AS signup_date FROM engagement", ENGAGEMENT),
        "available_dates": _plain("SELECT DISTINCT signup_date FROM engagement", ENGAGEMENT),
        "latest_stored_date": _plain(
            "SELECT max(signup_date) AS signup_date FROM engagement", ENGAGEMENT),
        "stored_dates": _plain(
            "SELECT signup_date, count(*) AS rows FROM engagement GROUP BY 1", ENGAGEMENT),
        "engagement_feature_range": _plain(
            "SELECT * FROM engagement WHERE signup_date"
            " BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'", ENGAGEMENT),
        "event_feature_range": _plain(
            "SELECT * FROM event_features WHERE signup_date"
            " BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'", EVENT_FEATURES),
        "user_history": _plain(
            "SELECT * FROM subs WHERE hs_user_id = (SELECT hs_user_id FROM subs"
            " GROUP BY hs_user_id ORDER BY count(*) DESC, hs_user_id LIMIT 1)", SUBS),
        "campaign_rollup_dropout": _plain("SELECT * FROM dropout", EVENTS, DROPOUT),
        "campaign_rollup_by_id": _plain(
            "SELECT * FROM dropout WHERE canvas_entry_date >= DATE '1996-01-01'",
            EVENTS, DROPOUT_BY_ID),
        "campaign_rollup_winback": _plain("SELECT * FROM winback", EVENTS, WINBACK),
        "campaign_rollup_group": _plain(
            "SELECT * FROM winback_groups", EVENTS, WINBACK_GROUPS),
        "variation_counts": _plain(
            "SELECT canvas_variation_name, count(*) AS count FROM dropout"
            " WHERE canvas_entry_date >= DATE '1996-01-01' GROUP BY 1", EVENTS, DROPOUT_BY_ID),
        "events_by_variation": _plain(
            f"SELECT canvas_variation_name, in_control_group, count(*) AS count FROM ev"
            f" WHERE {PAIR} GROUP BY 1, 2", EVENTS),
        "forward_interval_nearest": _plain(
            "SELECT hs_user_id, canvas_variation_name, canvas_entry_date, dt, subscription_id,"
            " next_voucher_code, next_free_trial_start_date, next_free_trial_end_date,"
            " next_paid_subscription_start_date, next_paid_subscription_end_date"
            " FROM after_entry", SUBS, EVENTS, DROPOUT, AFTER_ENTRY),
        "backward_nearest": _plain(
            "SELECT hs_user_id, subscription_id, canvas_variation_name, canvas_entry_date,"
            " paid_subscription_end_date, next_paid_subscription_start_date, next_voucher_code"
            " FROM lapsed", *WINBACK_CHAIN),
        "validity_interval_join": _plain(
            f"""SELECT hs_user_id, canvas_id, canvas_variation_name, e.dt AS event_date,
                       subscription_id, subscription_start_date, next_subscription_start_date,
                       next_paid_subscription_start_date
                FROM ev e JOIN sequence s ON s.hs_user_id = e.external_user_id
                 AND e.dt BETWEEN subscription_start_date
                              AND coalesce(next_subscription_start_date, {FAR})
                WHERE e.event_name = 'users_canvas_entry' AND e.canvas_name ILIKE '%winback%'""",
            SUBS, EVENTS, SEQUENCE),
        "next_subscription": _plain(
            "SELECT hs_user_id, subscription_id, dt, voucher_code, next_voucher_code,"
            " paid_subscription_start_date, next_paid_subscription_start_date,"
            " row_number() OVER (PARTITION BY hs_user_id ORDER BY dt, subscription_id) AS sub_rank"
            " FROM paid_sequence", SUBS, PAID_SEQUENCE),
        "experiment_labels": _plain("SELECT * FROM labels", *LABEL_CHAIN),
        "experiment_labels_by_campaign": _plain(
            "SELECT * FROM labels", SUBS, EVENTS, DROPOUT_BY_ID, AFTER_ENTRY, LABELS),
        "winback_target": _plain(
            f"""SELECT hs_user_id,
                  coalesce(paid_subscription_end_date, free_trial_end_date)
                    AS subscription_end_date,
                  experiment_group, num_offers_10, num_offers_20, num_offers_30, num_offers_40,
                  (canvas_entry_date - coalesce(paid_subscription_end_date,
                    free_trial_end_date))::INTEGER AS days_since_cancel,
                  (coalesce(paid_subscription_end_date, free_trial_end_date) - dt)::INTEGER
                    AS tenure_at_cancel,
                  ordinal - 1 AS num_previous_subscriptions,
                  CASE WHEN next_paid - canvas_entry_date <= 28 THEN 1 ELSE 0 END AS target
                FROM ordered JOIN winback_groups ON hs_user_id = external_user_id
                 AND canvas_entry_date BETWEEN
                     coalesce(paid_subscription_end_date, free_trial_end_date) AND next_paid""",
            SUBS, EVENTS, WINBACK_GROUPS, f"""
ordered AS (
  SELECT *, lead(paid_subscription_start_date, 1, {FAR}) OVER taken AS next_paid,
         row_number() OVER taken AS ordinal
  FROM subs WHERE subscription_type ILIKE 'b2c' AND hs_user_id IS NOT NULL
  WINDOW taken AS (PARTITION BY hs_user_id ORDER BY dt, subscription_id)
)"""),
        "winback_responders_control": _plain(
            "SELECT * FROM control_responders", *WINBACK_CHAIN, CONTROL_RESPONDERS),
        "winback_responders_treatment": _plain(
            "SELECT * FROM treatment_responders", *WINBACK_CHAIN, TREATMENT_RESPONDERS),
        "returns_by_voucher": _plain(
            "SELECT next_voucher_code, count(DISTINCT hs_user_id) AS num_returns"
            " FROM treated GROUP BY 1", *WINBACK_CHAIN, TREATED),
        "take_rate_treatment_users": _plain(
            "SELECT * FROM treated", *WINBACK_CHAIN, TREATED),
        "take_rate_treatment": _with_tail((*WINBACK_CHAIN, TREATED, year_bins), f"""
cut_list AS (SELECT list_sort(list_distinct(e)) AS e FROM cuts),
binned AS (
  SELECT *, {_bin('days_since_cancel', 'e', "len(e) - 1")} AS bin FROM treated_year, cut_list)
SELECT bin, count(*) AS users, avg(days_since_cancel) AS mean_days_since_cancel,
       avg(convert_28day_ind) AS convert_28day_rate, e[bin] AS lower, e[bin + 1] AS upper
FROM binned GROUP BY bin, e"""),
        "take_rate_treatment_equal_width": _with_tail((*WINBACK_CHAIN, TREATED), f"""
-- A single value is widened by a thousandth of itself to both sides, and the
-- lowest edge then stays where it is.
ends AS (SELECT min(days_since_cancel)::DOUBLE AS a, max(days_since_cancel)::DOUBLE AS b
         FROM treated_year),
span AS (
  SELECT a = b AS single,
         CASE WHEN a < b THEN a WHEN a = 0 THEN -0.001::DOUBLE
              ELSE a - 0.001::DOUBLE * abs(a) END AS lo,
         CASE WHEN a < b THEN b WHEN a = 0 THEN 0.001::DOUBLE
              ELSE b + 0.001::DOUBLE * abs(b) END AS hi
  FROM ends),
cut_list AS (SELECT [CASE WHEN single THEN lo ELSE lo - (hi - lo) * 0.001::DOUBLE END, lo + 1 * ((hi - lo) / 5),
    lo + 2 * ((hi - lo) / 5), lo + 3 * ((hi - lo) / 5), lo + 4 * ((hi - lo) / 5), hi] AS e
  FROM span),
binned AS (SELECT *, {_bin('days_since_cancel', 'e', '5')} AS bin FROM treated_year, cut_list)
SELECT bin, count(*) AS users, avg(days_since_cancel) AS mean_days_since_cancel,
       avg(convert_28day_ind) AS convert_28day_rate, e[bin] AS lower, e[bin + 1] AS upper
FROM binned GROUP BY bin, e"""),
        "take_rate_control_curve": _plain(
            "SELECT days_since_cancel, count(*) AS users,"
            " sum(convert_28day_ind)::BIGINT AS converted FROM held_out GROUP BY 1",
            *WINBACK_CHAIN, HELD_OUT),
        "take_rate_control": _with_tail(
            (*WINBACK_CHAIN, HELD_OUT, _qcut("days_since_cancel", "held_out", 8)), f"""
binned AS (SELECT *, {_bin('days_since_cancel', 'e', '8')} AS bin FROM held_out, cuts)
SELECT bin, count(*) AS users, avg(days_since_cancel) AS mean_days_since_cancel,
       avg(convert_28day_ind) AS convert_28day_rate, e[bin] AS lower, e[bin + 1] AS upper
FROM binned GROUP BY bin, e"""),
        "take_rate_control_equal_width": _with_tail((*WINBACK_CHAIN, HELD_OUT), f"""
cut_list AS (SELECT [1 - 364 * 0.001::DOUBLE, 1 + 1 * (364::DOUBLE / 5), 1 + 2 * (364::DOUBLE / 5),
    1 + 3 * (364::DOUBLE / 5), 1 + 4 * (364::DOUBLE / 5), 365] AS e),
binned AS (SELECT *, {_bin('days_since_cancel', 'e', '5')} AS bin FROM held_out, cut_list)
SELECT bin, count(*) AS users, avg(days_since_cancel) AS mean_days_since_cancel,
       avg(convert_28day_ind) AS convert_28day_rate, e[bin] AS lower, e[bin + 1] AS upper
FROM binned GROUP BY bin, e"""),
        "take_rate_10day_treatment": _plain(
            "SELECT (floor((days_since_cancel - 1) / 10.0) + 1)::BIGINT AS ten_day_bucket,"
            " avg(convert_28day_ind) AS take_rate, count(DISTINCT hs_user_id) AS num_users"
            " FROM treated GROUP BY 1", *WINBACK_CHAIN, TREATED),
        "take_rate_10day_control": _plain(
            "SELECT (floor((days_since_cancel - 1) / 10.0) + 1)::BIGINT AS ten_day_bucket,"
            " avg(convert_28day_ind) AS take_rate, count(DISTINCT hs_user_id) AS num_users"
            " FROM held_out GROUP BY 1", *WINBACK_CHAIN, HELD_OUT),
        "campaign_funnel": _funnel(),
        "daily_features_week1": _plain(
            f"SELECT hs_user_id, signup_date,"
            f" {WEEK1.format('content_starts')}::BIGINT AS week1_content_starts,"
            f" {WEEK1.format('returns')}::BIGINT AS week1_returns"
            " FROM engagement JOIN event_features USING (hs_user_id, signup_date)",
            ENGAGEMENT, EVENT_FEATURES),
        "feature_trends": _with_tail((ENGAGEMENT,), """
averages AS (
  SELECT hs_user_id, signup_date, """ + ", ".join(
            f"(day{d}_content_starts + day{d - 1}_content_starts + day{d - 2}_content_starts)"
            f" / 3.0::DOUBLE AS t{d}" for d in range(3, 8)) + """ FROM engagement),
slopes AS (
  SELECT *, ((t7 / (t6 + 1e-8) - 1) + (t6 / (t5 + 1e-8) - 1) + (t5 / (t4 + 1e-8) - 1)
             + (t4 / (t3 + 1e-8) - 1)) / 4 AS slope FROM averages)
SELECT hs_user_id, signup_date, """ + ", ".join(
            f"round(t{d}, 6) AS day{d}_trailing3day_avg_content_starts" for d in range(3, 8)) + """,
       round(sign(slope) * ln(1 + abs(slope)), 6) AS week1_content_starts_log_slope
FROM slopes"""),
        "median_daily_total": _plain(
            f"SELECT quantile_disc(({EIGHT_DAYS})::BIGINT, 0.5) AS median_starts FROM engagement",
            ENGAGEMENT),
        "median_week1": _plain(
            f"""SELECT quantile_disc((CASE WHEN e.hs_user_id IS NULL THEN 0
                         ELSE {EIGHT_DAYS} END)::BIGINT, 0.5) AS median_starts
                FROM subs s LEFT JOIN engagement e ON s.hs_user_id = e.hs_user_id
                WHERE {MARKET}""", SUBS, ENGAGEMENT),
        "training_frame": _plain(f"""
SELECT hs_user_id, signup_date, experiment_group,
       coalesce(discount_redeemed, 0) AS discount_redeemed,
       {", ".join(f"(experiment_group = '{g}')::INTEGER AS experiment_group_{g}"
                  for g in ("CN", "CR", "TN", "TR"))},
       free_trial_days,
       CASE WHEN num_offers_40 > 0 THEN 40 WHEN num_offers_30 > 0 THEN 30
            WHEN num_offers_20 > 0 THEN 20 ELSE 0 END AS max_discount_offered_c,
       {_CATEGORIES},
       CASE WHEN signup_date <= DATE '2000-06-30' THEN 'train' ELSE 'test' END AS split
FROM cohort JOIN labels USING (hs_user_id, signup_date) {_FEATURE_JOINS}
WHERE free_trial_days IN (7, 14)""", *LABEL_CHAIN, COHORT, ENGAGEMENT, EVENT_FEATURES),
        "scoring_frame": _plain(f"""
SELECT hs_user_id, signup_date, free_trial_days, 20 AS max_discount_offered_c, {_CATEGORIES}
FROM cohort {_FEATURE_JOINS}""", SUBS, COHORT, ENGAGEMENT, EVENT_FEATURES),
        "quantile_bins": _plain(
            f"SELECT hs_user_id, subscription_id, uplift_score,"
            f" {_bin('uplift_score', 'e', '10')} AS bin FROM pseudo, cuts",
            PSEUDO, _qcut("uplift_score", "pseudo", 10)),
        "quantile_bins_falling": _plain(
            f"SELECT hs_user_id, subscription_id, uplift_score,"
            f" 6 - {_bin('uplift_score', 'e', '5')} AS bin FROM pseudo, cuts",
            PSEUDO, _qcut("uplift_score", "pseudo", 5)),
        "equal_width_bins": _with_tail((PSEUDO,), """
span AS (SELECT min(uplift_score) AS lo, max(uplift_score) AS hi FROM pseudo)
SELECT hs_user_id, subscription_id, uplift_score,
       (1 + (SELECT count(*) FROM range(1, 5) AS inner_edges(i)
             WHERE uplift_score > lo + i * ((hi - lo) / 5)))::INTEGER AS bin
FROM pseudo, span"""),
        "histogram_density": _with_tail(
            (*WINBACK_CHAIN, CONTROL_RESPONDERS, TREATMENT_RESPONDERS, RESPONDERS,
             "yearly AS (SELECT * FROM responders WHERE plan_initial_term_months = 12)"),
            _histogram("yearly", "tenure_at_cancellation", "arm", 28)),
        "histogram_return_delay": _with_tail(
            (*WINBACK_CHAIN, CONTROL_RESPONDERS, TREATMENT_RESPONDERS, RESPONDERS,
             "later AS (SELECT * FROM responders"
             " WHERE days_until_return__from_previous_subscription_end_date > 0)"),
            _histogram("later", "days_until_return__from_previous_subscription_end_date",
                       "arm", 3)),
        "histogram_return_window": _with_tail(
            (*WINBACK_CHAIN, TREATMENT_RESPONDERS,
             "marked AS (SELECT *, days_until_return__from_previous_subscription_end_date <= 35"
             " AS back_within_35 FROM treatment_responders)"),
            _histogram("marked", "tenure_at_cancellation", "back_within_35", 28)),
        "histogram_density_monthly": _with_tail(
            (*WINBACK_CHAIN, CONTROL_RESPONDERS, TREATMENT_RESPONDERS, RESPONDERS,
             "monthly AS (SELECT * FROM responders WHERE plan_initial_term_months = 1)"),
            _histogram("monthly", "tenure_at_cancellation", "arm", 28)),
        "histogram_return_window_monthly": _with_tail(
            (*WINBACK_CHAIN, TREATMENT_RESPONDERS,
             "marked AS (SELECT *, days_until_return__from_previous_subscription_end_date <= 35"
             " AS back_within_35 FROM treatment_responders WHERE plan_initial_term_months = 1)"),
            _histogram("marked", "tenure_at_cancellation", "back_within_35", 28)),
        "histogram_email_return_delay": _with_tail(
            (*WINBACK_CHAIN, CONTROL_RESPONDERS, TREATMENT_RESPONDERS, RESPONDERS,
             "mailed AS (SELECT * FROM responders"
             " WHERE days_until_return__from_first_email_date > 0)"),
            _histogram("mailed", "days_until_return__from_first_email_date", "arm", 3)),
        "tenure_return_pairs_monthly": _plain(
            "SELECT tenure_at_cancellation,"
            " days_until_return__from_previous_subscription_end_date, count(*) AS count"
            " FROM treatment_responders WHERE tenure_at_cancellation > 0"
            " AND plan_initial_term_months = 1 GROUP BY 1, 2",
            *WINBACK_CHAIN, TREATMENT_RESPONDERS),
        "histogram_shared_edges": _with_tail((*WINBACK_CHAIN, TREATED), """
-- A histogram over a single value spans half a unit to either side of it.
span AS (SELECT min(days_since_cancel) - (CASE WHEN min(days_since_cancel)
                  = max(days_since_cancel) THEN 0.5::DOUBLE ELSE 0 END) AS lo,
                max(days_since_cancel) + (CASE WHEN min(days_since_cancel)
                  = max(days_since_cancel) THEN 0.5::DOUBLE ELSE 0 END) AS hi
         FROM treated_year),
placed AS (
  SELECT convert_28day_ind, lo, (hi - lo) / 50 AS w,
         (SELECT count(*) FROM range(1, 50) AS inner_edges(i)
          WHERE days_since_cancel >= lo + i * ((hi - lo) / 50)) AS bar
  FROM treated_year, span)
SELECT convert_28day_ind, bar, lo + bar * w AS lower, count(*) AS count,
       count(*) / sum(count(*)) OVER (PARTITION BY convert_28day_ind)::DOUBLE AS probability
FROM placed GROUP BY convert_28day_ind, bar, lo, w"""),
        "score_histogram": _with_tail((PSEUDO,), """
span AS (SELECT min(tr) AS lo, max(tr) AS hi FROM pseudo),
placed AS (
  SELECT lo, (hi - lo) / 10 AS w,
         (SELECT count(*) FROM range(1, 10) AS inner_edges(i)
          WHERE tr >= lo + i * ((hi - lo) / 10)) AS bar
  FROM pseudo, span)
SELECT 'all' AS "group", bar, lo + bar * w AS lower, count(*) AS count,
       count(*) / sum(count(*)) OVER ()::DOUBLE AS probability
FROM placed GROUP BY bar, lo, w"""),
        "kernel_density": _with_tail(
            (*WINBACK_CHAIN, CONTROL_RESPONDERS, TREATMENT_RESPONDERS, RESPONDERS), """
points AS (SELECT arm, days_until_return__from_previous_subscription_end_date::DOUBLE AS v
           FROM responders),
stats AS (SELECT arm, min(v) AS lo, max(v) AS hi, count(*) AS n,
                 stddev_samp(v) * pow(count(*), -0.2) AS h FROM points GROUP BY arm),
grid AS (SELECT arm, point::INTEGER AS point, lo + point * (hi - lo) / 199 AS x, n, h
         FROM stats, range(200) AS steps(point))
SELECT arm, point, round(x, 6) AS x,
       round(sum(exp(-0.5 * ((x - v) / h) * ((x - v) / h))) / (n * h * sqrt(2 * pi())), 6)
         AS density
FROM grid JOIN points USING (arm) GROUP BY arm, point, x, n, h"""),
        "box_summary": _with_tail(
            (*WINBACK_CHAIN, TREATMENT_RESPONDERS,
             _qcut("days_until_email__from_subscription_end_date", "treatment_responders", 10)),
            f"""
cut_list AS (SELECT list_sort(list_distinct(e)) AS e FROM cuts),
binned AS (
  SELECT {_bin('days_until_email__from_subscription_end_date', 'e', 'len(e) - 1')} AS bin,
         days_until_return__from_first_email_date AS v
  FROM treatment_responders, cut_list
  WHERE days_until_email__from_subscription_end_date > 0),
boxes AS (
  SELECT bin, count(v) AS rows, quantile_cont(v::DOUBLE, 0.25) AS q1,
         quantile_cont(v::DOUBLE, 0.5) AS median, quantile_cont(v::DOUBLE, 0.75) AS q3
  FROM binned GROUP BY bin)
SELECT bin, rows, q1, median, q3,
       min(v) FILTER (v >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
       max(v) FILTER (v <= q3 + 1.5 * (q3 - q1)) AS whisker_high
FROM binned JOIN boxes USING (bin) GROUP BY ALL"""),
        "email_delay_mean": _plain(
            "SELECT avg(days_until_email__from_subscription_end_date) AS mean_days_until_email"
            " FROM treatment_responders", *WINBACK_CHAIN, TREATMENT_RESPONDERS),
        "tenure_return_pairs": _plain(
            "SELECT tenure_at_cancellation,"
            " days_until_return__from_previous_subscription_end_date, count(*) AS count"
            " FROM treatment_responders WHERE tenure_at_cancellation > 0 GROUP BY 1, 2",
            *WINBACK_CHAIN, TREATMENT_RESPONDERS),
        "email_delay_steps": _plain(
            "SELECT (floor(days_until_email__from_subscription_end_date / 5.0) * 5)::BIGINT"
            " AS days_from, count(*) AS count FROM treatment_responders GROUP BY 1",
            *WINBACK_CHAIN, TREATMENT_RESPONDERS),
        "scores": _plain("SELECT * FROM score_table", PSEUDO, SCORES),
        "tracking_by_bin": _plain(
            f"""SELECT canvas_variation_name, in_control_group, uplift_score_bin,
                       count(*) AS events, count(DISTINCT external_user_id) AS users
                FROM ev JOIN newest ON external_user_id = hs_user_id
                WHERE canvas_name ILIKE '%ftdropout%' AND {PAIR} GROUP BY 1, 2, 3""",
            EVENTS, PSEUDO, SCORES, """
newest AS (SELECT * FROM score_table QUALIFY row_number() OVER (PARTITION BY hs_user_id
             ORDER BY signup_date DESC, uplift_score DESC) = 1)"""),
        "high_uplift_signups": _plain(
            "SELECT signup_date, count(*) AS count FROM score_table"
            " WHERE uplift_score_bin > 5 GROUP BY 1", PSEUDO, SCORES),
        "latest_score": _plain(
            "SELECT hs_user_id, uplift_score_bin, uplift_score FROM score_table"
            " QUALIFY row_number() OVER (PARTITION BY hs_user_id"
            " ORDER BY signup_date DESC, uplift_score DESC) = 1", PSEUDO, SCORES),
        "row_numbers": "SELECT o_custkey AS hs_user_id, o_orderkey AS subscription_id,"
                       " row_number() OVER (ORDER BY o_custkey, o_orderkey) AS row_number"
                       " FROM orders",
        "payload_batches": _with_tail((PSEUDO, SCORES), """
newest AS (SELECT * FROM score_table QUALIFY row_number() OVER (PARTITION BY hs_user_id
             ORDER BY signup_date DESC, uplift_score DESC) = 1),
dealt AS (SELECT *, row_number() OVER (ORDER BY hs_user_id)
                    % ceil((SELECT count(*) FROM newest) / 50.0)::BIGINT AS batch_request_num
          FROM newest)
SELECT batch_request_num, count(*)::INTEGER AS users,
       string_agg(hs_user_id::VARCHAR, ',' ORDER BY hs_user_id::VARCHAR) AS ids,
       sum(uplift_score_bin)::INTEGER AS bin_sum
FROM dealt GROUP BY 1"""),
        "delivered_batches": _with_tail((PSEUDO, SCORES), """
newest AS (SELECT DISTINCT hs_user_id FROM score_table),
dealt AS (SELECT row_number() OVER (ORDER BY hs_user_id)
                    % ceil((SELECT count(*) FROM newest) / 50.0)::BIGINT AS batch_request_num
          FROM newest)
SELECT batch_request_num, count(*)::INTEGER AS users FROM dealt GROUP BY 1"""),
        "score_generations": _with_tail((PSEUDO, SCORES), """
third AS (SELECT *, hs_user_id % 3 AS t, year(signup_date::DATE) = 1997 AS again FROM score_table),
again AS (SELECT DISTINCT signup_date FROM third WHERE again AND t = 0),
kept AS (
  SELECT signup_date, t, false AS whole FROM third WHERE signup_date NOT IN (SELECT signup_date FROM again)
  UNION ALL SELECT signup_date, t, true FROM third WHERE again AND t = 0)
SELECT year(signup_date::DATE)::INTEGER AS year, count(*) AS rows,
       count(*) FILTER (whole OR t >= 1) AS dated, count(*) FILTER (whole OR t = 2) AS binned,
       count(DISTINCT signup_date) AS dates
FROM kept GROUP BY 1"""),
        "classification_report": _with_tail((SUBS, PSEUDO, LABELLED_SCORES), """
called AS (SELECT label, (score > 0.5)::INTEGER AS said FROM labelled),
per_class AS (
  SELECT cls, count(*) FILTER (label = cls) AS support,
         count(*) FILTER (label = cls AND said = cls)
           / count(*) FILTER (said = cls)::DOUBLE AS p,
         count(*) FILTER (label = cls AND said = cls)
           / count(*) FILTER (label = cls)::DOUBLE AS r
  FROM called, (VALUES (0), (1)) AS classes(cls) GROUP BY cls),
scored AS (SELECT *, 2 * p * r / (p + r) AS f FROM per_class),
total AS (SELECT count(*) AS n, avg((label = said)::INTEGER) AS acc FROM called)
SELECT cls::VARCHAR AS class, p AS precision, r AS recall, f AS f1_score, support FROM scored
UNION ALL SELECT 'accuracy', acc, acc, acc, n FROM total
UNION ALL SELECT 'macro avg', sum(p) / 2, sum(r) / 2, sum(f) / 2, sum(support)::BIGINT FROM scored
UNION ALL SELECT 'weighted avg', sum(p * w), sum(r * w), sum(f * w), sum(support)::BIGINT
FROM (SELECT *, support / sum(support) OVER ()::DOUBLE AS w FROM scored)"""),
        "sigmoid_calibration": _with_tail((SUBS, PSEUDO), _sigmoids()),
        "prepared_features": _with_tail((SUBS, PAID), _PREPARED),
        "fold_sizes": _with_tail((SUBS, PAID), """
arms AS (
  SELECT 'TR' AS arm, (experiment_group = 'TR')::INTEGER AS responded FROM paid WHERE experiment_group LIKE 'T%'
  UNION ALL
  SELECT 'CR', (experiment_group = 'CR')::INTEGER FROM paid WHERE experiment_group LIKE 'C%'),
dealt AS (SELECT *, (row_number() OVER (PARTITION BY arm ORDER BY responded) % 8)::INTEGER AS fold FROM arms)
SELECT arm, fold, responded, count(*) AS count FROM dealt GROUP BY ALL"""),
        "oversampled_counts": _with_tail((SUBS, PAID), """
treated AS (SELECT *, (experiment_group = 'TR')::INTEGER AS "experiment_group_TR" FROM paid WHERE experiment_group LIKE 'T%')
SELECT "experiment_group_TR",
       (SELECT max(n) FROM (SELECT count(*) AS n FROM treated GROUP BY "experiment_group_TR")) AS rows,
       count(DISTINCT plan_renewal_term_months_c) AS values_of_plan_renewal_term_months_c,
       count(DISTINCT subscription_platform) AS values_of_subscription_platform,
       count(DISTINCT renewal_c) AS values_of_renewal_c,
       min(free_trial_days)::BIGINT AS low_free_trial_days, max(free_trial_days)::BIGINT AS high_free_trial_days,
       min(renewal_count)::BIGINT AS low_renewal_count, max(renewal_count)::BIGINT AS high_renewal_count,
       min(week1_events)::BIGINT AS low_week1_events, max(week1_events)::BIGINT AS high_week1_events
FROM treated GROUP BY 1"""),
        "uplift_identities": _with_tail((SUBS, PAID), """
by_year AS (SELECT strftime(signup_date, '%Y') AS year, count(*) AS users FROM paid GROUP BY 1)
SELECT year, users, users AS propensities, users AS opposite_tr, users AS opposite_cr, users AS uplifts,
       users AS binned, DATE '2022-06-01' AS run_date FROM by_year"""),
        "date_split": _plain("""
SELECT part, CASE WHEN experiment_group LIKE 'T%' THEN 'treatment' ELSE 'control' END AS arm, experiment_group,
       count(*) AS users, min(signup_date) AS first, max(signup_date) AS last
FROM cohort JOIN labels USING (hs_user_id, signup_date), (VALUES ('train'), ('test'), ('final')) AS parts(part)
WHERE free_trial_days IN (7, 14) AND CASE part
  WHEN 'train' THEN signup_date <= DATE '2000-06-30' - (365 + 28 + 1)
  WHEN 'test' THEN signup_date > DATE '2000-06-30' - (365 + 28 + 1)
  ELSE signup_date <= DATE '2000-06-30' - (365 + 1) END
GROUP BY ALL""", *LABEL_CHAIN, COHORT),
        "weeks_2_to_4": _with_tail((EVENTS,), """
dated AS (SELECT external_user_id AS hs_user_id, date_trunc('month', dt)::DATE AS signup_date, day(dt) AS d FROM ev)
SELECT hs_user_id, signup_date, count(*) FILTER (d <= 7) AS week1_events,
       count(*) FILTER (d BETWEEN 8 AND 14) AS week2_events, count(*) FILTER (d BETWEEN 15 AND 21) AS week3_events,
       count(*) FILTER (d BETWEEN 22 AND 28) AS week4_events, count(*) FILTER (d BETWEEN 8 AND 28) AS week_2to4_events
FROM dated WHERE d <= 28 GROUP BY 1, 2"""),
        "threshold_curve": _with_tail((SUBS, PSEUDO, LABELLED_SCORES), """
whole AS (SELECT sum(label) AS p, count(*) - sum(label) AS n FROM labelled),
steps AS (SELECT t.score AS threshold, sum(l.label)::BIGINT AS tp,
                 (count(*) - sum(l.label))::BIGINT AS fp
          FROM (SELECT DISTINCT score FROM labelled) t JOIN labelled l ON l.score >= t.score
          GROUP BY t.score)
SELECT threshold, tp, fp, tp / (tp + fp)::DOUBLE AS precision, tp / p::DOUBLE AS recall,
       fp / n::DOUBLE AS fpr, tp / p::DOUBLE AS tpr
FROM steps, whole"""),
        # Area under the ROC curve as the share of pairs in the right order.
        "curve_areas": _with_tail((SUBS, PSEUDO, LABELLED_SCORES), """
ones AS (SELECT score, count(*) AS c FROM labelled WHERE label = 1 GROUP BY score),
zeros AS (SELECT score, count(*) AS c FROM labelled WHERE label = 0 GROUP BY score),
roc AS (SELECT sum(o.c * z.c * (CASE WHEN o.score > z.score THEN 1.0
                                     WHEN o.score = z.score THEN 0.5 ELSE 0.0 END))::DOUBLE
               / ((SELECT sum(c) FROM ones) * (SELECT sum(c) FROM zeros))::DOUBLE AS roc_auc
        FROM ones o, zeros z),
steps AS (SELECT score, sum(sum(label)) OVER down AS tp, sum(count(*)) OVER down AS said
          FROM labelled GROUP BY score WINDOW down AS (ORDER BY score DESC)),
points AS (SELECT tp / (SELECT sum(label) FROM labelled)::DOUBLE AS r, tp / said::DOUBLE AS p
           FROM steps),
chained AS (SELECT r, p, lag(r, 1, 0.0) OVER up AS r0, lag(p, 1, 1.0) OVER up AS p0
            FROM points WINDOW up AS (ORDER BY r, p DESC)),
pr AS (SELECT sum((r - r0) * (p + p0) / 2) AS pr_auc FROM chained)
SELECT round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc FROM roc, pr"""),
        "feature_neighbours": _with_tail((SUBS, COHORT, ENGAGEMENT, EVENT_FEATURES), f"""
profiles AS (SELECT {_CATEGORIES}, free_trial_days FROM cohort {_FEATURE_JOINS}),
points AS (SELECT *, count(*) AS copies, row_number() OVER () AS id FROM profiles GROUP BY ALL),
pairs AS (
  SELECT a.id, (a.week1_content_starts - b.week1_content_starts) ** 2
             + (a.week1_returns - b.week1_returns) ** 2 + (a.renewal_count - b.renewal_count) ** 2
             + (a.free_trial_days - b.free_trial_days) ** 2
             + 50 * ((a.plan_renewal_term_months_c <> b.plan_renewal_term_months_c)::INTEGER
                     + (a.subscription_platform <> b.subscription_platform)::INTEGER
                     + (a.renewal_c <> b.renewal_c)::INTEGER) AS d,
         b.copies - (a.id = b.id)::INTEGER AS others
  FROM points a, points b),
nearest AS (
  SELECT id, list(d ORDER BY d)[1:5] AS d
  FROM pairs, range(5) AS copy(i) WHERE i < others GROUP BY id)
SELECT week1_content_starts::DOUBLE AS week1_content_starts, week1_returns::DOUBLE AS week1_returns,
       renewal_count::DOUBLE AS renewal_count, free_trial_days::DOUBLE AS free_trial_days,
       plan_renewal_term_months_c, renewal_c, subscription_platform, copies,
       d[1]::DOUBLE AS d1, d[2]::DOUBLE AS d2, d[3]::DOUBLE AS d3, d[4]::DOUBLE AS d4,
       d[5]::DOUBLE AS d5
FROM points JOIN nearest USING (id)"""),
        "calibration_table": _plain(
            """SELECT (1 + (SELECT count(*) FROM range(1, 10) AS inner_edges(i)
                         WHERE score > i * 0.1::DOUBLE))::INTEGER AS bin,
                      round(avg(score), 6) AS mean_score, round(avg(label), 6) AS actual_rate,
                      count(*) AS rows
               FROM labelled GROUP BY 1""", SUBS, PSEUDO, LABELLED_SCORES),
    }
    for name in ("forward_interval_nearest", "next_subscription", "winback_target"):
        sql[f"{name}_heavy"] = sql[name]    # the way of heavy users must not change a row
    for name in ("training_frame", "scoring_frame"):
        sql[f"{name}_bucketed"] = sql[name]
    return sql
