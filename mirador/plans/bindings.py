"""The roles of the clinical source tables, played by the given tables.

Events cohort: a user is the unit, the first sign-up the anchor, event types are item codes.
Sales cohort: a customer is the unit of the analysis table (treatment, outcome, covariates).
Every binding comes with the SQL text of the same table for the oracles.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from mirador.operators.windows import anchors
from mirador.plans.registry import Tables
from mirador.roles import Roles

LO, HI = dt.timedelta(minutes=-30), dt.timedelta(days=7)
LO_US, HI_US = -30 * 60 * 1_000_000, 7 * 24 * 3600 * 1_000_000

SALES = Roles("id", "t", "y", ("c_acctbal", "n_orders", "mean_price", "max_qty", "mean_discount"))
EXTERNAL_FROM_NATION = 20

ANCHOR_SQL = """anchor AS (
  SELECT user_id, min(ts) AS anchor_ts FROM events WHERE event_type = 'signup' GROUP BY user_id)"""

MEASURE_SQL = """measure AS (
  SELECT event_id, user_id, event_type, value, ts,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) >= 50 AS validated
  FROM events)"""

SALES_SQL = """lines AS (
  SELECT l_orderkey, count(*) AS n_lines,
         sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_back,
         max(l_quantity) AS max_qty, sum(CAST(round(l_discount * 100) AS BIGINT)) AS discount_c
  FROM lineitem GROUP BY l_orderkey),
sold AS (
  SELECT o_custkey, count(*) AS n_orders,
         sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS n_urgent,
         sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS price_c,
         sum(n_lines) AS n_lines, sum(n_back) AS n_back, max(max_qty) AS max_qty,
         sum(discount_c) AS discount_c
  FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey GROUP BY o_custkey),
sales AS (
  SELECT c_custkey AS id, c_nationkey, c_mktsegment, c_acctbal,
         CAST(coalesce(n_orders, 0) AS BIGINT) AS n_orders,
         CAST(price_c AS DOUBLE) / CAST(100 * n_orders AS DOUBLE) AS mean_price,
         max_qty,
         CAST(discount_c AS DOUBLE) / CAST(100 * n_lines AS DOUBLE) AS mean_discount,
         CASE WHEN n_urgent >= 2 THEN 1 ELSE 0 END AS t,
         CASE WHEN 100 * n_back > 35 * n_lines THEN 1 ELSE 0 END AS y
  FROM customer LEFT JOIN sold ON o_custkey = c_custkey)"""

# Closed-form stand-ins for fitted models, so metrics have exact SQL counterparts.
SCORE_SQL = """scored AS (
  SELECT *,
    round(1 / (1 + exp(-(0.15 * (n_orders - 10) + 0.0001 * c_acctbal - 0.4))), 6) AS y1,
    round(1 / (1 + exp(-(0.05 * (n_orders - 10) - 0.0002 * c_acctbal + 0.8))), 6) AS y0,
    round(1 / (1 + exp(-(0.3 * (n_orders - 9) + 0.00005 * c_acctbal))), 6) AS propensity,
    round((c_acctbal - 4500) / 25000 + (n_orders - 10) * 0.01, 6) AS ite,
    CASE WHEN c_nationkey >= 20 THEN 'external' ELSE 'internal' END AS cohort
  FROM sales),
observed AS (SELECT *, CASE WHEN t = 1 THEN y1 ELSE y0 END AS p FROM scored)"""


def anchor(t: Tables) -> DataFrame:
    return anchors(
        t("events", "user_id", "ts", "event_type"), "user_id", "ts", F.col("event_type") == "signup"
    )


def measurements(t: Tables) -> DataFrame:
    """Long measurement table with a flag for the validated feed."""
    k = F.get_json_object("props", "$.k").cast("int")
    return t("events").select(
        "event_id", "user_id", "event_type", "value", "ts", (k >= 50).alias("validated")
    )


def cents(c: str) -> Column:
    """Whole cents: sums of them do not depend on the order of addition."""
    return F.round(F.col(c) * 100).cast("long")


def sales(t: Tables) -> DataFrame:
    """Analysis table of the sales cohort.

    Lines are reduced per order before they meet the orders, on the key they meet on.
    """
    lines = t("lineitem", "l_orderkey", "l_returnflag", "l_quantity", "l_discount")
    lines = lines.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("n_back"),
        F.max("l_quantity").alias("max_qty"), F.sum(cents("l_discount")).alias("discount_c"),
    )
    orders = t("orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    sold = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    sold = sold.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.count(F.when(F.col("o_orderpriority") == "1-URGENT", 1)).alias("n_urgent"),
        F.sum(cents("o_totalprice")).alias("price_c"),
        F.sum("n_lines").alias("n_lines"), F.sum("n_back").alias("n_back"),
        F.max("max_qty").alias("max_qty"), F.sum("discount_c").alias("discount_c"),
    )
    customers = t("customer", "c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    joined = customers.join(sold, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select(
        F.col("c_custkey").alias("id"), "c_nationkey", "c_mktsegment", "c_acctbal",
        F.coalesce("n_orders", F.lit(0).cast("long")).alias("n_orders"),
        F.try_divide(F.col("price_c").cast("double"), (100 * F.col("n_orders")).cast("double"))
        .alias("mean_price"),
        "max_qty",
        F.try_divide(F.col("discount_c").cast("double"), (100 * F.col("n_lines")).cast("double"))
        .alias("mean_discount"),
        F.when(F.col("n_urgent") >= 2, 1).otherwise(0).alias("t"),
        F.when(100 * F.col("n_back") > 35 * F.col("n_lines"), 1).otherwise(0).alias("y"),
    )


def _logistic(z: Column) -> Column:
    return F.round(1 / (1 + F.exp(-z)), 6)


def scored_sales(t: Tables) -> DataFrame:
    """The sales cohort with closed-form predictions, effects and propensities."""
    n, bal = F.col("n_orders"), F.col("c_acctbal")
    y1 = _logistic(0.15 * (n - 10) + 0.0001 * bal - 0.4)
    y0 = _logistic(0.05 * (n - 10) - 0.0002 * bal + 0.8)
    scored = sales(t).withColumns({
        "y1": y1, "y0": y0,
        "propensity": _logistic(0.3 * (n - 9) + 0.00005 * bal),
        "ite": F.round((bal - 4500) / 25000 + (n - 10) * 0.01, 6),
        "cohort": F.when(F.col("c_nationkey") >= EXTERNAL_FROM_NATION, "external").otherwise("internal"),
    })
    return scored.withColumn("p", F.when(F.col("t") == 1, F.col("y1")).otherwise(F.col("y0")))
