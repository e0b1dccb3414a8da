"""The input tables derived from the test tables by the rules of FIXTURES.md.

Only tests, the bench and the registered queries use this module; the library
takes any frames that pass ``tables.check_columns``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the fixture rules (FIXTURES.md sections 1 and 2).
EVENT_BY_LINE = [
    "users_canvas_entry",
    "users_messages_email_delivery",
    "users_messages_email_open",
    "users_messages_email_click",
    "users_canvas_conversion",
    "users_messages_email_unsubscribe",
    "users_messages_webhook_send",
]
VOUCHERS = ["SAVE20OFF", "Winback30off", "FT40OFF", "PARTNER"]
VARIATIONS = ["Control", "Winback 10", "Offer 40"]
PLATFORMS = ["ios", "android", "web"]


def _pick(index, values):
    """CASE index WHEN 0 THEN values[0] ...; null beyond the list."""
    out = F.when(index == 0, F.lit(values[0]))
    for position, value in enumerate(values[1:], start=1):
        out = out.when(index == position, F.lit(value))
    return out


class Fixtures:
    """Lazy frames over one test-data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}.parquet")

    @property
    def subscriptions(self) -> DataFrame:
        orders = self._read("orders")
        customers = self._read("customer").select("c_custkey", "c_nationkey")
        key = F.col("o_orderkey")
        on_trial = key % 2 == 0
        term = _pick(key % 3, [12, 1, 6]).cast("int")
        priority = F.col("o_orderpriority")
        trial_days = (
            F.when(priority.isin("1-URGENT", "3-MEDIUM"), 7)
            .when(priority == "5-LOW", 30)
            .otherwise(14)
        )
        dt = F.col("o_orderdate").cast("date")
        trial_end = F.when(on_trial, F.date_add(dt, trial_days))
        paid_start = F.when(~on_trial, dt).when(F.col("o_orderstatus") != "F", trial_end)
        paid_days = F.when(term == 12, 365).otherwise(30 * term)
        return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("o_custkey").alias("hs_user_id"),
            key.alias("subscription_id"),
            dt.alias("dt"),
            F.col("o_orderdate").alias("created_timestamp"),
            F.col("o_orderdate").alias("updated_timestamp"),
            F.when(key % 10 < 9, "B2C").otherwise("B2B").alias("subscription_type"),
            F.when(F.col("c_nationkey") < 20, "US").otherwise("CA").alias("country_code"),
            trial_days.alias("free_trial_days"),
            F.when(on_trial, dt).alias("free_trial_start_date"),
            trial_end.alias("free_trial_end_date"),
            paid_start.alias("paid_subscription_start_date"),
            F.date_add(paid_start, paid_days).alias("paid_subscription_end_date"),
            term.alias("plan_initial_term_months"),
            term.alias("plan_renewal_term_months"),
            (key % 4).cast("int").alias("renewal_count"),
            _pick(key % 3, PLATFORMS).alias("subscription_platform"),
            _pick(key % 5, VOUCHERS).alias("voucher_code"),
        )

    @property
    def campaign_events(self) -> DataFrame:
        lines = self._read("lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"
        )
        orders = self._read("orders").select("o_orderkey", "o_custkey")
        user = F.col("o_custkey")
        offer = F.concat(F.lit("offer_"), (10 + 10 * (F.col("l_partkey") % 4)).cast("string"))
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            user.alias("external_user_id"),
            F.col("l_shipdate").cast("date").alias("dt"),
            (F.col("l_suppkey") % 4).alias("canvas_id"),
            F.when(F.col("l_suppkey") % 2 == 0, "Email_FTDropout_v1")
            .otherwise("Email Winback 2021").alias("canvas_name"),
            _pick(user % 3, VARIATIONS).alias("canvas_variation_name"),
            _pick(F.col("l_linenumber") - 1, EVENT_BY_LINE).alias("event_name"),
            F.when(user % 3 == 0, "wait").otherwise(offer).alias("canvas_step_name"),
            (user % 3 == 0).alias("in_control_group"),
        )

    @property
    def campaigns(self) -> DataFrame:
        return (
            self.campaign_events
            .groupBy(F.col("canvas_id").alias("id"), F.col("canvas_name").alias("name"))
            .agg(
                F.min("dt").cast("timestamp_ntz").alias("created_at"),
                F.min("dt").cast("timestamp_ntz").alias("first_entry"),
                F.max("dt").cast("timestamp_ntz").alias("last_entry"),
            )
        )

    def _daily(self, measures) -> DataFrame:
        """One row per (user, signup date) with ``day{k}_{measure}`` columns.

        Measures are taken per day first and spread into columns after, so a
        distinct count needs no copy of the rows for each of the eight days.
        """
        lines = self._read("lineitem").select(
            "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag"
        )
        orders = self._read("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        per_day = (
            lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy(
                F.col("o_custkey").alias("hs_user_id"),
                F.col("o_orderdate").cast("date").alias("signup_date"),
                (F.col("l_linenumber") - 1).alias("day"),
            )
            .agg(*[measure.alias(name) for name, measure in measures.items()])
        )
        spread = [
            F.coalesce(F.max(F.when(F.col("day") == day, F.col(name))),
                       F.lit(0).cast("bigint")).alias(f"day{day}_{name}")
            for name in measures
            for day in range(8)
        ]
        return per_day.groupBy("hs_user_id", "signup_date").agg(*spread)

    @property
    def engagement_features(self) -> DataFrame:
        return self._daily({
            "content_starts": F.sum(F.col("l_quantity").cast("bigint")),
            "distinct_parts": F.countDistinct("l_partkey"),
        })

    @property
    def event_features(self) -> DataFrame:
        return self._daily({"returns": F.count_if(F.col("l_returnflag") == "R")})

    @property
    def pseudo_scores(self) -> DataFrame:
        """Fixed stand-in for model scores, one row per subscription."""
        key = F.col("o_orderkey")
        tr = (key * 37 % 1009) / F.lit(1009.0)
        cr = (key * 53 % 997) / F.lit(997.0)
        return self._read("orders").select(
            F.col("o_custkey").alias("hs_user_id"),
            key.alias("subscription_id"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("signup_date"),
            tr.alias("propensity_TR"),
            cr.alias("propensity_CR"),
        )
