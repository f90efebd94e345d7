"""Scans, filters, joins, aggregates, reshaping and rules on the given tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from mirador.functions.numeric import clean_number, to_fraction
from mirador.functions.text import mentions, never_mentions
from mirador.functions.timing import DAY, HOUR, epoch_micros, from_epoch_millis, whole_units
from mirador.operators import cleaning, codes, dosing, lookups, reshape, summaries, windows
from mirador.plans.bindings import (
    ANCHOR_SQL,
    HI,
    HI_US,
    LO,
    LO_US,
    MEASURE_SQL,
    SALES,
    SALES_SQL,
    anchor,
    cents,
    measurements,
    sales,
)
from mirador.plans.registry import Tables, query
from mirador.roles import Roles
from mirador.sources import tables as sources
from mirador.sources.workspace import scratch

# ---- scans and sinks ---------------------------------------------------------------------


@query("scan_project", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders")
def scan_project(t: Tables):
    return sources.scan(
        t.spark, f"{t.folder}/orders.parquet", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"]
    )


@query("unit_spine", "SELECT DISTINCT user_id FROM events")
def unit_spine(t: Tables):
    return sources.unit_spine(t("events"), "user_id")


@query("csv_roundtrip", "SELECT * FROM orders")
def csv_roundtrip(t: Tables):
    orders = t("orders")
    path = scratch(t.spark, "csv")
    sources.write_csv(orders, path)
    return sources.read_csv(t.spark, path, orders.schema)


@query("table_roundtrip", "SELECT * FROM customer")
def table_roundtrip(t: Tables):
    """Partitioned table write, read back under its schema contract."""
    customers = t("customer")
    path = scratch(t.spark, "customers")
    sources.write_table(customers, path, ["c_mktsegment"])
    back = t.spark.read.schema(customers.schema).parquet(path).select(*customers.columns)
    return sources.validate_schema(back, customers.schema)


@query("report_export", """
SELECT o_orderpriority, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS price_cents
FROM orders GROUP BY o_orderpriority""")
def report_export(t: Tables):
    """A report table as text and back."""
    report = t("orders", "o_orderpriority", "o_totalprice").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.sum(cents("o_totalprice")).alias("price_cents")
    )
    path = scratch(t.spark, "report")
    sources.write_csv(report.coalesce(1), path)
    return sources.read_csv(t.spark, path, report.schema)


@query("epoch_millis_to_time", """
SELECT event_id, date_trunc('millisecond', ts) AS ts FROM events""")
def epoch_millis_to_time(t: Tables):
    """Times kept as epoch milliseconds, as the internal source does."""
    millis = t("events", "event_id", "ts").select(
        "event_id", F.floor(epoch_micros("ts") / 1000).cast("long").alias("ms")
    )
    return millis.select("event_id", from_epoch_millis("ms").alias("ts"))


@query("total_dose_flag", """
SELECT l_orderkey AS stay_id, CASE WHEN sum(l_quantity * CASE l_returnflag WHEN 'A' THEN 5.0 WHEN 'N' THEN 0.2
  WHEN 'R' THEN 1.0 END) >= 100 THEN 1 ELSE 0 END AS treated
FROM lineitem GROUP BY l_orderkey""")
def total_dose_flag(t: Tables):
    """Flag by the equivalent dose of the whole stay."""
    lines = t("lineitem", "l_orderkey", "l_returnflag", "l_quantity").withColumnRenamed("l_orderkey", "stay_id")
    factors = {"A": 5.0, "N": 0.2, "R": 1.0}
    totals = dosing.equivalent(lines, ["stay_id"], "l_returnflag", F.col("l_quantity"), factors, F.lit(1))
    return totals.select("stay_id", F.coalesce(F.col("total") >= 100, F.lit(False)).cast("int").alias("treated"))


@query("role_assignment", f"""
WITH {SALES_SQL} {" UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS known FROM sales"
    for c in ("c_nationkey", "c_mktsegment", *SALES.x))}""")
def role_assignment(t: Tables):
    """Covariates are the columns without another part; their known values."""
    table = sales(t)
    roles = Roles.infer(table, SALES.id, SALES.t, SALES.y)
    counts = [F.struct(F.lit(c).alias("feature"), F.count(c).alias("known")) for c in roles.x]
    return table.agg(F.array(*counts).alias("c")).select(F.inline("c"))


# ---- filters -----------------------------------------------------------------------------


@query("anchor_window_filter", f"""
WITH {ANCHOR_SQL}
SELECT e.event_id, e.user_id, e.event_type, e.value,
       (epoch_us(e.ts) - epoch_us(a.anchor_ts)) / 6e7 AS offset_min
FROM events e JOIN anchor a ON a.user_id = e.user_id
WHERE epoch_us(e.ts) - epoch_us(a.anchor_ts) BETWEEN {LO_US} AND {HI_US} AND e.value > 0""")
def anchor_window_filter(t: Tables):
    events = t("events", "event_id", "user_id", "event_type", "value", "ts").filter("value > 0")
    kept = windows.in_window(events, anchor(t), "user_id", "ts", "anchor_ts", LO, HI)
    return kept.select("event_id", "user_id", "event_type", "value", "offset_min")


@query("interval_overlap_filter", f"""
WITH {ANCHOR_SQL}
SELECT e.event_id, e.user_id, e.value
FROM events e JOIN anchor a ON a.user_id = e.user_id
WHERE epoch_us(e.ts) <= epoch_us(a.anchor_ts) + 86400000000
  AND epoch_us(e.ts) + CAST(round(e.value * 60000000) AS BIGINT) >= epoch_us(a.anchor_ts)""")
def interval_overlap_filter(t: Tables):
    events = t("events", "event_id", "user_id", "ts", "value").transform(lookups.attach, anchor(t), "user_id")
    start, a = epoch_micros("ts"), epoch_micros("anchor_ts")
    stop = start + F.round(F.col("value") * 60_000_000).cast("long")
    day = F.lit(24 * 3600 * 1_000_000)
    return events.filter(windows.overlaps(start, stop, a, a + day)).select("event_id", "user_id", "value")


@query("whole_hour_window", f"""
WITH {ANCHOR_SQL}, d AS (
  SELECT e.event_id, e.user_id,
         CAST(trunc((epoch_us(e.ts) - epoch_us(a.anchor_ts)) / 3.6e9) AS BIGINT) AS hours
  FROM events e JOIN anchor a ON a.user_id = e.user_id)
SELECT * FROM d WHERE hours > 0 AND hours < 72""")
def whole_hour_window(t: Tables):
    events = t("events", "event_id", "user_id", "ts").transform(lookups.attach, anchor(t), "user_id")
    hours = whole_units("ts", "anchor_ts", "HOUR").alias("hours")
    return events.select("event_id", "user_id", hours).filter("hours > 0 AND hours < 72")


@query("code_list_semi", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type IN ('PROMO', 'SMALL'))""")
def code_list_semi(t: Tables):
    parts = codes.in_codes(t("part", "p_partkey", "p_type"), "p_type", ["PROMO", "SMALL"])
    lines = t("lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return codes.in_codes(lines, "l_partkey", parts.withColumnRenamed("p_partkey", "l_partkey"))


@query("compound_code_filter", """
SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity FROM lineitem
WHERE (l_returnflag = 'R' AND l_linenumber IN (1, 2, 3))
   OR (l_returnflag = 'A' AND l_linenumber = 7)
   OR (l_returnflag = 'N' AND l_linenumber IN (4, 6))""")
def compound_code_filter(t: Tables):
    pairs = [("R", 1), ("R", 2), ("R", 3), ("A", 7), ("N", 4), ("N", 6)]
    lines = t("lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return codes.in_codes(lines, ["l_returnflag", "l_linenumber"], pairs).select(lines.columns)


@query("text_source_filter", """
SELECT doc_id, source, lang, CASE WHEN lower(lang) NOT LIKE '%e%' THEN TRUE ELSE FALSE END AS manual
FROM documents WHERE lower(source) LIKE '%1%' OR source IS NULL""")
def text_source_filter(t: Tables):
    docs = t("documents", "doc_id", "source", "lang")
    kept = docs.filter(mentions("source", "1", null_ok=True))
    return kept.withColumn("manual", never_mentions("lang", "e"))


@query("sentinel_dose_cast", """
SELECT p_partkey, TRY_CAST(substr(p_brand, 7) AS DOUBLE) AS dose FROM part
WHERE substr(p_brand, 7) NOT IN ('1', '2')""")
def sentinel_dose_cast(t: Tables):
    dose = clean_number(F.expr("substr(p_brand, 7)"), ("1", "2"))
    return t("part", "p_partkey", "p_brand").select("p_partkey", dose.alias("dose")).filter(
        "dose IS NOT NULL"
    )


RULES = [
    cleaning.Rule("click", True, lower=3, upper=140),
    cleaning.Rule("click", False, lower=4.5, open_lower=True, upper=90),
    cleaning.Rule("purchase", True, divide_above=60),
    cleaning.Rule("view", lower=8, upper=40, open_lower=True),
    cleaning.Rule("error", upper=250),
]
RULED_SQL = f"""{MEASURE_SQL}, ruled AS (
  SELECT event_id, user_id, event_type, ts, validated, CASE
    WHEN event_type = 'click' AND validated AND (value < 3 OR value > 140) THEN NULL
    WHEN event_type = 'click' AND NOT validated AND (value <= 4.5 OR value > 90) THEN NULL
    WHEN event_type = 'purchase' AND validated AND value > 60 THEN value / 10
    WHEN event_type = 'view' AND (value <= 8 OR value > 40) THEN NULL
    WHEN event_type = 'error' AND value > 250 THEN NULL
    ELSE value END AS value
  FROM measure)"""


def ruled(t: Tables):
    return cleaning.apply_rules(measurements(t), RULES, "event_type", "value", "validated")


@query("outlier_rules", f"WITH {RULED_SQL} SELECT event_id, event_type, validated, value FROM ruled")
def outlier_rules(t: Tables):
    return ruled(t).select("event_id", "event_type", "validated", "value")


@query("clean_and_drop", f"""
WITH {RULED_SQL} SELECT event_id, user_id, event_type, value FROM ruled
WHERE value IS NOT NULL AND event_type IN ('click', 'purchase', 'view')""")
def clean_and_drop(t: Tables):
    kept = cleaning.require(ruled(t), ["value"], {"event_type": ["click", "purchase", "view"]})
    return kept.select("event_id", "user_id", "event_type", "value")


@query("harmonise_schema", """
SELECT 'supplier' AS side, s_suppkey AS unit_id, s_nationkey AS nation,
       CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END AS overdrawn, s_acctbal AS balance FROM supplier
UNION ALL
SELECT 'customer', c_custkey, c_nationkey, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END, c_acctbal
FROM customer""")
def harmonise_schema(t: Tables):
    keep = ["side", "unit_id", "nation", "overdrawn", "balance"]

    def side(df, name: str, p: str):
        rename = {f"{p}_nationkey": "nation", f"{p}_acctbal": "balance"}
        rename["s_suppkey" if p == "s" else "c_custkey"] = "unit_id"
        maps = {
            "side": F.lit(name),
            "overdrawn": F.when(F.col(f"{p}_acctbal") < 0, 1).otherwise(0),
        }
        return cleaning.harmonise(df, rename, keep, maps)

    return side(t("supplier"), "supplier", "s").unionByName(side(t("customer"), "customer", "c"))


@query("arm_summary", f"""
WITH {SALES_SQL}
SELECT t, count(*) AS n, round(avg(CAST(y AS DOUBLE)), 6) AS outcome_rate,
       round(avg(c_acctbal), 4) AS mean_balance, max(n_orders) AS max_orders
FROM sales GROUP BY t""")
def arm_summary(t: Tables):
    return summaries.by_arm(sales(t), "t", [
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("y").cast("double")), 6).alias("outcome_rate"),
        F.round(F.avg("c_acctbal"), 4).alias("mean_balance"), F.max("n_orders").alias("max_orders"),
    ])


# ---- joins -------------------------------------------------------------------------------


@query("same_time_lookup", """
SELECT p.event_id, p.user_id, d.device_id, d.device_value
FROM (SELECT event_id, user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase') p
LEFT JOIN (
  SELECT event_id AS device_id, user_id, CAST(ts AS DATE) AS day, value AS device_value,
    row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY value DESC, event_id) AS rn
  FROM events WHERE event_type = 'view' AND value >= 20) d
  ON p.user_id = d.user_id AND p.day = d.day AND d.rn = 1""")
def same_time_lookup(t: Tables):
    day = F.to_date("ts").alias("day")
    events = t("events", "event_id", "user_id", "event_type", "value", "ts")
    left = events.filter("event_type = 'purchase'").select("event_id", "user_id", day)
    right = events.select(
        F.col("event_id").alias("device_id"), "user_id", day, "event_type",
        F.col("value").alias("device_value"),
    )
    found = lookups.lookup_at(
        left, right, ["user_id", "day"],
        (F.col("event_type") == "view") & (F.col("device_value") >= 20),
        keep=[-F.col("device_value"), "device_id"],
    )
    return found.select("event_id", "user_id", "device_id", "device_value")


PROBE_SQL = "probe AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase')"
REF_SQL = """ref AS (
  SELECT event_id AS ref_id, user_id, ts AS ref_ts, event_type AS ref_type, value AS ref_value
  FROM events WHERE event_type IN ('click', 'view'))"""
BAND_SQL = """epoch_us(r.ref_ts) > epoch_us(p.ts) - 43200000000
   AND epoch_us(r.ref_ts) < epoch_us(p.ts) + 10800000000"""


def probe_and_ref(t: Tables):
    events = t("events", "event_id", "user_id", "event_type", "value", "ts")
    probe = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")
    ref = codes.in_codes(events, "event_type", ["click", "view"]).select(
        F.col("event_id").alias("ref_id"), "user_id", F.col("ts").alias("ref_ts"),
        F.col("event_type").alias("ref_type"), F.col("value").alias("ref_value"),
    )
    return probe, ref


@query("band_join", f"""
WITH {PROBE_SQL}, {REF_SQL}
SELECT p.event_id, p.user_id, count(r.ref_id) AS refs, min(r.ref_value) AS lowest,
       max(r.ref_value) AS highest, max(r.ref_ts) AS latest
FROM probe p LEFT JOIN ref r ON r.user_id = p.user_id AND {BAND_SQL}
GROUP BY p.event_id, p.user_id""")
def band_join(t: Tables):
    probe, ref = probe_and_ref(t)
    return lookups.band_join(
        probe.select("event_id", "user_id", "ts"), ref, "user_id", "event_id", "ts", "ref_ts",
        12 * HOUR, 3 * HOUR,
        {"refs": ("count", "ref_id"), "lowest": ("min", "ref_value"),
         "highest": ("max", "ref_value"), "latest": ("max", "ref_ts")},
    ).drop("ts")


ASOF_SQL = f"""{PROBE_SQL}, {REF_SQL}, ranked AS (
  SELECT p.event_id, p.user_id, p.ts, p.value, r.ref_id, r.ref_type, r.ref_value, r.ref_ts,
    row_number() OVER (PARTITION BY p.event_id ORDER BY
      CASE r.ref_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 END NULLS LAST,
      CASE WHEN r.ref_ts <= p.ts THEN 1 ELSE 2 END,
      abs(epoch_us(r.ref_ts) - epoch_us(p.ts)), r.ref_value DESC, r.ref_id) AS pick
  FROM probe p LEFT JOIN ref r ON r.user_id = p.user_id AND {BAND_SQL}),
matched AS (SELECT * FROM ranked WHERE pick = 1)"""


def matched(t: Tables):
    probe, ref = probe_and_ref(t)
    return lookups.asof_match(
        probe, ref, "user_id", "ts", "ref_ts", 12 * HOUR, 3 * HOUR,
        payload=["ref_id", "ref_type", "ref_value", "ref_ts"],
        kind=F.when(F.col("ref_type") == "click", 1).otherwise(2), kinds=[1, 2],
        tie=[-F.col("ref_value"), F.col("ref_id")],
    )


@query("asof_priority_match", f"""
WITH {ASOF_SQL} SELECT event_id, user_id, ref_id, ref_type, ref_value FROM matched""")
def asof_priority_match(t: Tables):
    return matched(t).select("event_id", "user_id", "ref_id", "ref_type", "ref_value")


@query("asof_nearest_before", f"""
WITH {PROBE_SQL}, v AS (
  SELECT event_id AS ref_id, user_id, ts AS ref_ts FROM events WHERE event_type = 'view'),
r AS (SELECT p.event_id, p.user_id, v.ref_id, row_number() OVER (
        PARTITION BY p.event_id ORDER BY v.ref_ts DESC NULLS LAST, v.ref_id) AS pick
      FROM probe p LEFT JOIN v ON v.user_id = p.user_id AND v.ref_ts <= p.ts)
SELECT event_id, user_id, ref_id FROM r WHERE pick = 1""")
def asof_nearest_before(t: Tables):
    probe, ref = probe_and_ref(t)
    found = lookups.asof_match(
        probe, ref.filter("ref_type = 'view'"), "user_id", "ts", "ref_ts", None, None, ["ref_id"],
        tie=[F.col("ref_id")], direction="backward",
    )
    return found.select("event_id", "user_id", "ref_id")


@query("onset_range_join", f"""
WITH {ANCHOR_SQL}, score AS (
  SELECT user_id, time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '1970-01-01 00:00:00')
           + INTERVAL '12 hours' AS score_ts,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS score
  FROM events WHERE event_type <> 'error' GROUP BY 1, 2 HAVING score >= 2000),
susp AS (SELECT event_id, user_id, ts AS suspected_ts, value FROM events WHERE event_type = 'error'),
s1 AS (
  SELECT u.user_id, u.event_id, u.suspected_ts, s.score_ts, s.score,
         s.score >= 2000 AND u.value >= 10 AS onset,
         row_number() OVER (PARTITION BY u.user_id
           ORDER BY u.suspected_ts NULLS FIRST, u.event_id NULLS FIRST, s.score_ts NULLS FIRST) AS rn
  FROM susp u JOIN score s ON s.user_id = u.user_id
   AND s.score_ts >= u.suspected_ts - INTERVAL '48 hours'
   AND s.score_ts <= u.suspected_ts + INTERVAL '24 hours')
SELECT s1.user_id, s1.event_id, s1.suspected_ts, s1.score_ts, s1.score, s1.onset FROM s1
LEFT JOIN anchor a ON a.user_id = s1.user_id
WHERE rn = 1
  AND trunc((epoch_us(s1.suspected_ts) - epoch_us(a.anchor_ts)) / 3.6e9) < 24""")
def onset_range_join(t: Tables):
    events = t("events", "event_id", "user_id", "event_type", "value", "ts")
    ends = F.window("ts", "12 hours")["end"].cast("timestamp_ntz")
    score = (
        events.filter("event_type <> 'error'").withColumn("score_ts", ends)
        .groupBy("user_id", "score_ts").agg(F.sum(cents("value")).alias("score"))
        .filter("score >= 2000")
    )
    susp = events.filter("event_type = 'error'").select(
        "event_id", "user_id", F.col("ts").alias("suspected_ts"), "value"
    )
    first = lookups.onset(
        susp, score, "user_id", "suspected_ts", "score_ts", 48 * HOUR, 24 * HOUR, ["score"],
        order=["suspected_ts", "event_id"],
    )
    first = first.withColumn("onset", (F.col("score") >= 2000) & (F.col("value") >= 10))
    joined = first.join(anchor(t), "user_id", "left")
    return joined.filter(whole_units("suspected_ts", "anchor_ts", "HOUR") < 24).select(
        "user_id", "event_id", "suspected_ts", "score_ts", "score", "onset"
    )


@query("person_to_stay_rollup", """
WITH stay AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT s.o_orderkey AS stay_id, min(f.o_totalprice) AS min_price, max(f.o_totalprice) AS max_price,
       CAST(sum(CAST(round(f.o_totalprice * 100) AS BIGINT)) AS BIGINT) AS sum_cents, count(*) AS rows_in_window
FROM stay s JOIN orders f ON f.o_custkey = s.o_custkey
 AND f.o_orderdate >= s.o_orderdate - INTERVAL '60 days'
 AND f.o_orderdate <= s.o_orderdate + INTERVAL '30 days'
GROUP BY s.o_orderkey""")
def person_to_stay_rollup(t: Tables):
    orders = t("orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    stays = orders.filter("o_orderpriority = '1-URGENT'").select(
        F.col("o_orderkey").alias("stay_id"), "o_custkey", F.col("o_orderdate").alias("intime")
    )
    facts = orders.select("o_custkey", "o_orderdate", "o_totalprice", cents("o_totalprice").alias("cents"))
    return lookups.rollup_window(
        facts, stays, "o_custkey", "stay_id", "o_orderdate", "intime", -60 * DAY, 30 * DAY,
        {
            "min_price": ("min", "o_totalprice"), "max_price": ("max", "o_totalprice"),
            "sum_cents": ("sum", "cents"), "rows_in_window": ("count", "o_totalprice"),
        },
    )


@query("full_outer_reconcile", """
SELECT coalesce(s.nation, c.nation) AS nation, suppliers, customers FROM
  (SELECT s_nationkey AS nation, count(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s
FULL OUTER JOIN
  (SELECT c_nationkey AS nation, count(*) AS customers FROM customer
   WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 0 GROUP BY 1) c
ON s.nation = c.nation""")
def full_outer_reconcile(t: Tables):
    s = t("supplier", "s_nationkey", "s_acctbal").filter("s_acctbal > 5000").groupBy(
        F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"))
    c = t("customer", "c_nationkey", "c_mktsegment", "c_acctbal").filter(
        "c_mktsegment = 'BUILDING' AND c_acctbal < 0"
    ).groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers"))
    return lookups.reconcile(s, c, ["nation"])


@query("covariate_assembly", """
WITH o AS (SELECT o_custkey, count(*) AS n_orders, max(o_totalprice) AS max_price,
             min(o_orderdate) AS first_order FROM orders GROUP BY 1),
u AS (SELECT o_custkey, count(*) AS n_urgent FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
f AS (SELECT o_custkey, max(o_totalprice) AS max_filled FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
l AS (SELECT o_custkey, max(l_quantity) AS max_qty, min(l_discount) AS min_discount
      FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT c_custkey, n_orders, max_price, first_order, n_urgent, max_filled, max_qty, min_discount, n_name
FROM customer LEFT JOIN o ON o.o_custkey = c_custkey LEFT JOIN u ON u.o_custkey = c_custkey
LEFT JOIN f ON f.o_custkey = c_custkey LEFT JOIN l ON l.o_custkey = c_custkey
LEFT JOIN nation ON n_nationkey = c_nationkey""")
def covariate_assembly(t: Tables):
    orders = t("orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority",
               "o_orderstatus").withColumnRenamed("o_custkey", "c_custkey")
    # One pass over the orders gives three of the parts.
    per_customer = orders.groupBy("c_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"), F.max("o_totalprice").alias("max_price"),
        F.min("o_orderdate").alias("first_order"),
        F.expr("nullif(count_if(o_orderpriority = '1-URGENT'), 0)").alias("n_urgent"),
        F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("max_filled"),
    )
    lines = t("lineitem", "l_orderkey", "l_quantity", "l_discount").groupBy(
        F.col("l_orderkey").alias("o_orderkey")
    ).agg(F.max("l_quantity").alias("q"), F.min("l_discount").alias("d"))
    per_line = orders.select("o_orderkey", "c_custkey").join(lines, "o_orderkey").groupBy(
        "c_custkey").agg(F.max("q").alias("max_qty"), F.min("d").alias("min_discount"))
    nations = t("customer", "c_custkey", "c_nationkey").join(
        t("nation", "n_nationkey", "n_name"), F.col("n_nationkey") == F.col("c_nationkey")
    ).select("c_custkey", "n_name")
    return lookups.assemble(
        t("customer", "c_custkey"), [per_customer, per_line, nations], "c_custkey", check_unique=False
    )


# ---- aggregates --------------------------------------------------------------------------


@query("mode_presence", f"""
WITH {ANCHOR_SQL}
SELECT e.user_id, count(*) > 0 AS present,
       string_agg(DISTINCT event_type, '; ' ORDER BY event_type) AS modes
FROM events e JOIN anchor a ON a.user_id = e.user_id
WHERE e.value >= 20 AND epoch_us(e.ts) - epoch_us(a.anchor_ts) < 86400000000 GROUP BY e.user_id""")
def mode_presence(t: Tables):
    events = t("events", "user_id", "event_type", "value", "ts").filter("value >= 20")
    kept = windows.in_window(
        events, anchor(t), "user_id", "ts", "anchor_ts", None, DAY, closed="left"
    )
    return summaries.presence(kept, ["user_id"], "event_type")


@query("distinct_texts", """
WITH pairs AS (SELECT DISTINCT l_suppkey, l_returnflag || ' ' || l_linenumber AS mode FROM lineitem),
placed AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY mode) AS place,
                  count(*) OVER (PARTITION BY l_suppkey) AS n FROM pairs)
SELECT l_suppkey, string_agg(mode, '; ' ORDER BY mode) AS texts, greatest(max(n) - 5, 0) AS rest
FROM placed WHERE place <= 5 GROUP BY l_suppkey""")
def distinct_texts(t: Tables):
    """The first five kinds of lines of each supplier, and how many more it has."""
    lines = t("lineitem", "l_suppkey", "l_returnflag", "l_linenumber")
    modes = lines.select("l_suppkey", F.concat_ws(" ", "l_returnflag", "l_linenumber").alias("mode"))
    return summaries.distinct_texts(modes, ["l_suppkey"], "mode", most=5)


DAILY_ONLY_SQL = """daily AS (
  SELECT e.user_id, e.event_type,
    CAST(floor((epoch_us(e.ts) - epoch_us(a.anchor_ts)) / 86400e6) AS BIGINT) AS day,
    round(sum(e.value), 6) AS total
  FROM events e JOIN anchor a ON a.user_id = e.user_id
  GROUP BY 1, 2, 3)"""
DAILY_SQL = f"{ANCHOR_SQL}, {DAILY_ONLY_SQL}"


def daily(t: Tables, dense: bool = False):
    events = t("events", "user_id", "event_type", "ts", "value").transform(lookups.attach, anchor(t), "user_id")
    summed = dosing.per_day(events, ["user_id", "event_type"], "ts", "value", "anchor_ts", dense)
    return summed.withColumn("total", F.round("total", 6))


@query("daily_dose", f"WITH {DAILY_SQL} SELECT * FROM daily")
def daily_dose(t: Tables):
    return daily(t)


@query("daily_dose_dense", f"""
WITH {DAILY_SQL}, span AS (
  SELECT user_id, event_type, unnest(generate_series(min(day), max(day))) AS day
  FROM daily GROUP BY 1, 2)
SELECT s.user_id, s.event_type, s.day, coalesce(d.total, 0.0) AS total
FROM span s LEFT JOIN daily d USING (user_id, event_type, day)""")
def daily_dose_dense(t: Tables):
    return daily(t, dense=True)


THRESHOLDS = {"click": 60, "view": 75, "purchase": 100, "error": 90}
TREATED_SQL = """treated AS (
  SELECT DISTINCT user_id FROM daily
  WHERE (event_type = 'click' AND total >= 60) OR (event_type = 'view' AND total >= 75)
     OR (event_type = 'purchase' AND total >= 100) OR (event_type = 'error' AND total >= 90))"""


@query("treated_flag", f"""
WITH {DAILY_SQL}, {TREATED_SQL}
SELECT u.user_id, CASE WHEN t.user_id IS NOT NULL THEN 1 ELSE 0 END AS treated
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN treated t ON t.user_id = u.user_id""")
def treated_flag(t: Tables):
    spine = sources.unit_spine(t("events"), "user_id")
    return dosing.threshold_flag(daily(t), "user_id", "event_type", "total", THRESHOLDS, spine)


@query("interval_dose_summary", f"""
WITH {ANCHOR_SQL}
SELECT e.user_id, round(sum(e.value), 6) AS total_duration, max(e.value / 80) AS max_rate
FROM events e JOIN anchor a ON a.user_id = e.user_id
WHERE e.event_type = 'purchase' AND epoch_us(e.ts) <= epoch_us(a.anchor_ts) + {HI_US}
GROUP BY e.user_id""")
def interval_dose_summary(t: Tables):
    doses = t("events", "user_id", "event_type", "ts", "value").filter("event_type = 'purchase'")
    kept = windows.in_window(doses, anchor(t), "user_id", "ts", "anchor_ts", None, HI)
    kept = kept.withColumn("rate", F.col("value") / 80)
    summed = dosing.interval_summary(kept, ["user_id"], "value", "rate")
    return summed.withColumn("total_duration", F.round("total_duration", 6))


STATS_SQL = f"""{RULED_SQL}, stats AS (
  SELECT user_id, event_type, round(median(value), 6) AS median, max(value) AS max, min(value) AS min
  FROM ruled WHERE value IS NOT NULL GROUP BY 1, 2)"""


def stats(t: Tables):
    table = summaries.item_stats(ruled(t), ["user_id", "event_type"], "value")
    return table.withColumn("median", F.round("median", 6))


@query("feature_stats", f"WITH {STATS_SQL} SELECT * FROM stats")
def feature_stats(t: Tables):
    return stats(t)


@query("worst_ratio", f"""
WITH {ASOF_SQL}
SELECT user_id, min(value / nullif(ref_value, 0)) AS worst FROM matched
WHERE ref_id IS NOT NULL GROUP BY user_id""")
def worst_ratio(t: Tables):
    pairs = matched(t).filter("ref_id IS NOT NULL")
    return summaries.worst_ratio(pairs, ["user_id"], "value", "ref_value")


@query("anchor_window_max", f"""
WITH {ANCHOR_SQL}
SELECT e.user_id, max(e.value) AS max_value FROM events e JOIN anchor a ON a.user_id = e.user_id
WHERE e.event_type = 'error' AND epoch_us(e.ts) - epoch_us(a.anchor_ts) BETWEEN 0 AND {HI_US}
GROUP BY e.user_id""")
def anchor_window_max(t: Tables):
    errors = t("events", "user_id", "event_type", "ts", "value").filter("event_type = 'error'")
    kept = windows.in_window(errors, anchor(t), "user_id", "ts", "anchor_ts", dt.timedelta(0), HI)
    return kept.groupBy("user_id").agg(F.max("value").alias("max_value"))


@query("dose_equivalent_total", """
SELECT o_custkey, round(sum(dose), 4) AS total, round(sum(dose) / nullif(max(days), 0), 4) AS per_unit
FROM (SELECT o_custkey,
        TRY_CAST(CAST(l_quantity AS VARCHAR) AS DOUBLE) *
          CASE l_returnflag WHEN 'A' THEN 5.0::DOUBLE WHEN 'N' THEN 0.25::DOUBLE WHEN 'R' THEN 1.0::DOUBLE END AS dose,
        CAST(abs(date_diff('day', o_orderdate, l_shipdate)) AS DOUBLE) AS days
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey
      WHERE l_quantity <> 1) GROUP BY o_custkey""")
def dose_equivalent_total(t: Tables):
    lines = t("lineitem", "l_orderkey", "l_quantity", "l_returnflag", "l_shipdate")
    orders = t("orders", "o_orderkey", "o_custkey", "o_orderdate")
    text = F.col("l_quantity").cast("string")
    joined = lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    days = F.abs(F.datediff("l_shipdate", "o_orderdate")).cast("double")
    total = dosing.equivalent(
        joined.filter(text != "1.0"), ["o_custkey"], "l_returnflag", clean_number(text, ("1.0",)),
        {"A": 5, "N": 0.25, "R": 1}, days,
    )
    return total.select("o_custkey", F.round("total", 4).alias("total"), F.round("per_unit", 4).alias("per_unit"))


@query("all_rows_flag", """
SELECT o_custkey, CAST(bool_and(CASE WHEN l_tax < 0.08 THEN TRUE ELSE FALSE END) AS INTEGER) AS flag
FROM lineitem FULL OUTER JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON o_orderkey = l_orderkey
GROUP BY o_custkey""")
def all_rows_flag(t: Tables):
    # Lines are reduced per order first; lines of orders left out end in the null group.
    lines = t("lineitem", "l_orderkey", "l_tax").groupBy("l_orderkey").agg(
        F.bool_and(F.coalesce(F.col("l_tax") < 0.08, F.lit(False))).alias("low")
    )
    orders = t("orders", "o_orderkey", "o_custkey", "o_orderstatus").filter("o_orderstatus <> 'P'")
    joined = lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey"), "full")
    return summaries.all_true(joined, ["o_custkey"], F.col("low"))


@query("first_day_peak", """
WITH f AS (SELECT user_id, min(ts) AS first FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT e.user_id, max(e.value) AS peak FROM events e JOIN f ON f.user_id = e.user_id
WHERE e.event_type = 'click'
  AND trunc((epoch_us(e.ts) + CAST(round(e.value * 60000000) AS BIGINT) - epoch_us(f.first)) / 3.6e9) <= 24
GROUP BY e.user_id""")
def first_day_peak(t: Tables):
    clicks = t("events", "user_id", "event_type", "ts", "value").filter("event_type = 'click'")
    # Interval end: start plus ``value`` minutes.
    stop = F.expr("timestampadd(MICROSECOND, cast(round(value * 60000000) as bigint), ts)")
    return summaries.peak_within(clicks.withColumn("stop", stop), "user_id", "ts", "stop", "value", 24)


@query("dedup_first", """
SELECT user_id, event_type, event_id, ts, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events)
WHERE rn = 1""")
def dedup_first(t: Tables):
    events = t("events", "user_id", "event_type", "event_id", "ts", "value")
    return lookups.first_by(events, ["user_id", "event_type"], ["ts", "event_id"])


# ---- union and reshape -------------------------------------------------------------------


@query("union_feeds", f"""
WITH {MEASURE_SQL} SELECT event_id, user_id, event_type, value, validated FROM measure
WHERE event_type IN ('click', 'error')""")
def union_feeds(t: Tables):
    events = t("events", "event_id", "user_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").cast("int")
    both = reshape.union_feeds({True: events.filter(k >= 50), False: events.filter(k < 50)})
    return codes.in_codes(both, "event_type", ["click", "error"]).drop("props")


FEATURES = {"activity": ["click", "view"], "money": ["purchase"], "trouble": ["error"]}


def feature_sql(source: str) -> str:
    return f"""feature AS (
  SELECT event_id, user_id, value, CASE WHEN event_type IN ('click', 'view') THEN 'activity'
    WHEN event_type = 'purchase' THEN 'money' WHEN event_type = 'error' THEN 'trouble' END AS feature
  FROM {source} WHERE event_type IN ('click', 'view', 'purchase', 'error')),
fstats AS (
  SELECT user_id, feature, round(median(value), 6) AS median, max(value) AS max, min(value) AS min
  FROM feature WHERE value IS NOT NULL GROUP BY 1, 2)"""


FEATURE_SQL = f"{RULED_SQL}, {feature_sql('ruled')}"


def features(t: Tables):
    return reshape.map_items(ruled(t), "event_type", FEATURES)


def feature_table(t: Tables):
    table = summaries.item_stats(features(t), ["user_id", "feature"], "value")
    return table.withColumn("median", F.round("median", 6))


@query("feature_long", f"WITH {FEATURE_SQL} SELECT event_id, user_id, feature, value FROM feature")
def feature_long(t: Tables):
    return features(t).select("event_id", "user_id", "feature", "value")


@query("feature_pivot", f"""
WITH {FEATURE_SQL} SELECT user_id, {", ".join(
    f"max(CASE WHEN feature = '{f}' THEN {m} END) AS {m}_{f}"
    for f in FEATURES for m in ("median", "max", "min"))}
FROM fstats GROUP BY user_id""")
def feature_pivot(t: Tables):
    return reshape.widen(
        feature_table(t), ["user_id"], "feature", list(FEATURES), ["median", "max", "min"]
    )


PICKS = [("median", "activity"), ("max", "money"), ("min", "trouble")]


@query("feature_select_wide", f"""
WITH {FEATURE_SQL} SELECT user_id, {", ".join(
    f"max(CASE WHEN feature = '{f}' THEN {m} END) AS {m}_{f}" for m, f in PICKS)}
FROM fstats GROUP BY user_id""")
def feature_select_wide(t: Tables):
    return reshape.pick_wide(feature_table(t), ["user_id"], "feature", PICKS)


# ---- rules and conversions ---------------------------------------------------------------


@query("bin_midpoint", """
SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 55.0 WHEN 'FURNITURE' THEN 65.0
    WHEN 'HOUSEHOLD' THEN 75.0 ELSE 80.0 END::DOUBLE AS weight,
  CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'AUTOMOBILE' THEN 0 END AS machine
FROM customer""")
def bin_midpoint(t: Tables):
    weights = {"BUILDING": 55.0, "FURNITURE": 65.0, "HOUSEHOLD": 75.0}
    return t("customer", "c_custkey", "c_mktsegment").select(
        "c_custkey", cleaning.recode("c_mktsegment", weights, F.lit(80.0)).alias("weight"),
        cleaning.recode("c_mktsegment", {"MACHINERY": 1, "AUTOMOBILE": 0}).alias("machine"),
    )


@query("percent_to_fraction", """
SELECT event_id, CASE WHEN value > 100 THEN NULL WHEN value >= 20 THEN value / 100
  WHEN value > 1 THEN NULL ELSE value END AS fraction FROM events""")
def percent_to_fraction(t: Tables):
    return t("events", "event_id", "value").select("event_id", to_fraction("value").alias("fraction"))


STEPS = [
    ("click", 1, 4, 0.1), ("click", 4, 9, 0.25), ("click", 9, 16, 0.5), ("click", 16, None, 0.75),
    ("view", 2, 12, 0.2), ("view", 12, 30, 0.4), ("view", 40, None, 0.8),
]
STEP_SQL = """
SELECT event_id, CAST(CASE
  WHEN event_type = 'click' THEN CASE WHEN value >= 1 AND value < 4 THEN 0.1
    WHEN value >= 4 AND value < 9 THEN 0.25 WHEN value >= 9 AND value < 16 THEN 0.5
    WHEN value >= 16 THEN 0.75 ELSE 0.05 END
  WHEN event_type = 'view' THEN CASE WHEN value >= 2 AND value < 12 THEN 0.2
    WHEN value >= 12 AND value < 30 THEN 0.4 WHEN value >= 40 THEN 0.8 ELSE 0.05 END
  ELSE 0.05 END AS DOUBLE) AS fraction FROM events"""


@query("step_lookup", STEP_SQL)
def step_lookup(t: Tables):
    step = dosing.step_value("event_type", "value", STEPS, 0.05)
    return t("events", "event_id", "event_type", "value").select("event_id", step.alias("fraction"))


@query("step_table_join", STEP_SQL)
def step_table_join(t: Tables):
    """The same steps as a table."""
    steps = t.spark.createDataFrame(
        [(g, float(lo), None if hi is None else float(hi), v) for g, lo, hi, v in STEPS],
        "grp string, lo double, hi double, value double",
    )
    events = t("events", "event_id", "event_type", "value")
    return dosing.join_steps(events, "event_type", "value", steps, 0.05, "fraction").select("event_id", "fraction")


@query("dose_normalise", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, round(CASE
  WHEN l_returnflag = 'A' AND l_linestatus = 'O' AND l_linenumber = 1 THEN l_quantity / 80
  WHEN l_returnflag = 'A' AND l_linestatus = 'O' AND l_linenumber = 2 THEN l_quantity * 1000 / 80
  WHEN l_returnflag = 'N' AND l_linestatus = 'F' AND l_linenumber = 3 THEN l_quantity
  WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber = 4 THEN l_quantity * 0.125
  END, 6) AS dose_norm FROM lineitem""")
def dose_normalise(t: Tables):
    lines = t("lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
              "l_returnflag", "l_linestatus").withColumn("weight", F.lit(80.0))
    factors = [
        ("A", "O", 1, 1.0, True), ("A", "O", 2, 1000.0, True),
        ("N", "F", 3, 1.0, False), ("R", "F", 4, 0.125, False),
    ]
    keys = ["l_returnflag", "l_linestatus", "l_linenumber"]
    done = dosing.normalise(lines, keys, factors, "l_quantity", "weight")
    return done.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                       F.round("dose_norm", 6).alias("dose_norm"))


@query("unit_convert", """
SELECT c_custkey, c_nationkey, round(c_acctbal * 0.357, 6) AS c_acctbal,
  CASE WHEN c_nationkey = 7 THEN CAST(round(CAST(c_acctbal * 7.50061683 AS DECIMAL(38, 9)), 1) AS DOUBLE)
       ELSE c_acctbal END AS pressure
FROM customer""")
def unit_convert(t: Tables):
    customers = t("customer", "c_custkey", "c_nationkey", "c_acctbal")
    pressure = cleaning.convert_coded("c_acctbal", "c_nationkey", {7: 7.50061683}, 1)
    converted = cleaning.convert(customers.withColumn("pressure", pressure), {"c_acctbal": 0.357})
    return converted.withColumn("c_acctbal", F.round("c_acctbal", 6))


@query("horizon_outcome", f"""
WITH {ANCHOR_SQL}, d AS (SELECT user_id, min(ts) AS death FROM events
  WHERE event_type = 'error' AND value >= 120 GROUP BY 1)
SELECT a.user_id,
  CASE WHEN epoch_us(d.death) - epoch_us(a.anchor_ts) < 14 * 86400000000 THEN 1 ELSE 0 END AS y_open,
  CASE WHEN epoch_us(d.death) - epoch_us(a.anchor_ts) BETWEEN 0 AND 14 * 86400000000 THEN 1 ELSE 0 END AS y_closed
FROM anchor a LEFT JOIN d ON d.user_id = a.user_id""")
def horizon_outcome(t: Tables):
    deaths = windows.anchors(
        t("events", "user_id", "ts", "event_type", "value"), "user_id", "ts",
        (F.col("event_type") == "error") & (F.col("value") >= 120), "death",
    )
    return anchor(t).join(deaths, "user_id", "left").select(
        "user_id",
        windows.within_horizon("death", "anchor_ts", 14 * DAY).alias("y_open"),
        windows.within_horizon("death", "anchor_ts", 14 * DAY, closed=True, lower=dt.timedelta(0))
        .alias("y_closed"),
    )


# ---- compositions ------------------------------------------------------------------------

COHORT_SQL = f"""{ANCHOR_SQL}, {RULED_SQL}, windowed AS (
  SELECT r.* FROM ruled r JOIN anchor a ON a.user_id = r.user_id
  WHERE epoch_us(r.ts) - epoch_us(a.anchor_ts) BETWEEN {LO_US} AND {HI_US}),
{feature_sql("windowed")}, cohort AS (
  SELECT u.user_id, {", ".join(f"max(CASE WHEN feature = '{f}' THEN {m} END) AS {m}_{f}" for m, f in PICKS)}
  FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN fstats s ON s.user_id = u.user_id
  GROUP BY u.user_id)"""


def measurement_cohort_table(t: Tables):
    """Windowed, cleaned measurements of both feeds as one row of features per unit."""
    kept = windows.in_window(measurements(t), anchor(t), "user_id", "ts", "anchor_ts", LO, HI)
    kept = codes.in_codes(kept, "event_type", [c for cs in FEATURES.values() for c in cs])
    clean = cleaning.require(
        cleaning.apply_rules(kept, RULES, "event_type", "value", "validated"), ["value"]
    )
    table = summaries.item_stats(
        reshape.map_items(clean, "event_type", FEATURES), ["user_id", "feature"], "value"
    ).withColumn("median", F.round("median", 6))
    wide = reshape.pick_wide(table, ["user_id"], "feature", PICKS)
    spine = sources.unit_spine(t("events"), "user_id")
    return lookups.assemble(spine, [wide], "user_id", check_unique=False)


@query("measurement_cohort", f"WITH {COHORT_SQL} SELECT * FROM cohort")
def measurement_cohort(t: Tables):
    return measurement_cohort_table(t)


@query("missingness_profile", f"""
WITH {COHORT_SQL} {" UNION ALL ".join(
    f"SELECT '{m}_{f}' AS feature, round(avg(CASE WHEN {m}_{f} IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS missing FROM cohort"
    for m, f in PICKS)}""")
def missingness_profile(t: Tables):
    table = measurement_cohort_table(t)
    shares = summaries.missingness(table, [f"{m}_{f}" for m, f in PICKS])
    return shares.withColumn("missing", F.round("missing", 6))


@query("assumption_fill", f"""
WITH {COHORT_SQL} SELECT user_id, coalesce(median_activity, 0.0) AS median_activity,
  coalesce(max_money, 400.0) AS max_money, min_trouble FROM cohort""")
def assumption_fill(t: Tables):
    return cleaning.fill(measurement_cohort_table(t), {"median_activity": 0.0, "max_money": 400.0})


VIEW_STEPS = ", ".join(
    f"({low}, {'NULL' if high is None else high}, {share}::DOUBLE)" for kind, low, high, share in STEPS if kind == "view"
)
OXY_SQL = f"""{ANCHOR_SQL}, probe AS (
  SELECT event_id, user_id, ts, value FROM events JOIN anchor USING (user_id)
  WHERE event_type = 'purchase' AND epoch_us(ts) - epoch_us(anchor_ts) BETWEEN {LO_US} AND {HI_US}),
ref AS (
  SELECT event_id AS ref_id, user_id, ts AS ref_ts, event_type AS ref_type, CASE
    WHEN event_type = 'click' AND value > 100 THEN NULL
    WHEN event_type = 'click' AND value >= 20 THEN value / 100
    WHEN event_type = 'click' AND value > 1 THEN NULL
    WHEN event_type = 'click' THEN value
    ELSE coalesce((SELECT max(share) FROM (VALUES {VIEW_STEPS}) steps (low, high, share)
                   WHERE value >= low AND (high IS NULL OR value < high)), 0.21::DOUBLE) END AS ref_value
  FROM events WHERE event_type IN ('click', 'view') AND value > 0)"""


@query("oxygenation_match", f"""
WITH {OXY_SQL}, ranked AS (
  SELECT p.event_id, p.user_id, p.value, r.ref_id, r.ref_value,
    row_number() OVER (PARTITION BY p.event_id ORDER BY
      CASE r.ref_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 END NULLS LAST,
      CASE WHEN r.ref_ts <= p.ts THEN 1 ELSE 2 END,
      abs(epoch_us(r.ref_ts) - epoch_us(p.ts)), r.ref_value DESC NULLS LAST, r.ref_id) AS pick
  FROM probe p LEFT JOIN ref r ON r.user_id = p.user_id AND {BAND_SQL})
SELECT user_id, min(round(value / nullif(ref_value, 0), 6)) AS worst, count(*) AS probes,
       count(ref_id) AS with_reference
FROM ranked WHERE pick = 1 AND value >= 1 GROUP BY user_id""")
def oxygenation_match(t: Tables):
    probe, ref = probe_and_ref(t)
    probe = windows.in_window(probe, anchor(t), "user_id", "ts", "anchor_ts", LO, HI)
    estimate = dosing.step_value("ref_type", "ref_value", STEPS, 0.21)
    ref = ref.filter("ref_value > 0").withColumn(
        "fraction",
        F.when(F.col("ref_type") == "click", to_fraction("ref_value")).otherwise(estimate),
    )
    found = lookups.asof_match(
        probe, ref, "user_id", "ts", "ref_ts", 12 * HOUR, 3 * HOUR, ["ref_id", "fraction"],
        kind=F.when(F.col("ref_type") == "click", 1).otherwise(2), kinds=[1, 2],
        tie=[-F.coalesce("fraction", F.lit(-1.0)), F.col("ref_id")],
    )
    found = found.filter("value >= 1").withColumn(
        "ratio", F.round(F.try_divide("value", "fraction"), 6)
    )
    return found.groupBy("user_id").agg(
        F.min("ratio").alias("worst"), F.count(F.lit(1)).alias("probes"),
        F.count("ref_id").alias("with_reference"),
    )


ANALYSIS_SQL = f"""{COHORT_SQL}, {DAILY_ONLY_SQL}, {TREATED_SQL},
death AS (SELECT user_id, min(ts) AS death FROM events WHERE event_type = 'error' AND value >= 120 GROUP BY 1)"""


@query("analysis_table", f"""
WITH {ANALYSIS_SQL}
SELECT c.user_id, CASE WHEN t.user_id IS NOT NULL THEN 1 ELSE 0 END AS treated,
  CASE WHEN epoch_us(death) - epoch_us(anchor_ts) < 14 * 86400000000 THEN 1 ELSE 0 END AS outcome,
  coalesce(median_activity, 0.0) AS median_activity, coalesce(max_money, 400.0) AS max_money, min_trouble
FROM cohort c LEFT JOIN treated t ON t.user_id = c.user_id
LEFT JOIN anchor a ON a.user_id = c.user_id LEFT JOIN death d ON d.user_id = c.user_id""")
def analysis_table(t: Tables):
    cohort = measurement_cohort_table(t)
    outcome = horizon_outcome(t).select("user_id", F.col("y_open").alias("outcome"))
    table = lookups.assemble(
        cohort, [treated_flag(t), outcome], "user_id", check_unique=False
    )
    filled = cleaning.fill(table, {"median_activity": 0.0, "max_money": 400.0, "outcome": 0})
    return filled.select(
        "user_id", "treated", "outcome", "median_activity", "max_money", "min_trouble"
    )


@query("external_analysis_table", f"""
WITH {SALES_SQL}
SELECT id AS unit_id, t AS treated, y AS outcome, coalesce(mean_price, 400.0) * 0.0555 AS price,
  coalesce(max_qty, 0.0) AS quantity, mean_discount AS discount
FROM sales WHERE c_nationkey >= 20""")
def external_analysis_table(t: Tables):
    outside = sales(t).filter("c_nationkey >= 20")
    filled = cleaning.fill(outside, {"mean_price": 400.0, "max_qty": 0.0})
    converted = cleaning.convert(filled, {"mean_price": 0.0555})
    return cleaning.harmonise(
        converted,
        {"id": "unit_id", "t": "treated", "y": "outcome", "mean_price": "price",
         "max_qty": "quantity", "mean_discount": "discount"},
        ["unit_id", "treated", "outcome", "price", "quantity", "discount"],
    )
