"""A hot key must be split over tasks: seen in the final plan once thresholds are tiny."""

import contextlib
import datetime as dt
import io

import pytest
from pyspark.sql import functions as F

from mirador.functions.timing import DAY
from mirador.operators import codes, lookups, summaries, windows

TINY = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture()
def tiny(spark):
    before = {k: spark.conf.get(k, None) for k in TINY}
    for k, v in TINY.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture()
def events(tiny, tmp_path):
    """Half of 60,000 rows belong to one of 3,000 units."""
    ids = tiny.range(0, 60_000, numPartitions=12)
    unit = F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 3000)
    rows = ids.select(
        F.col("id").alias("event_id"), unit.alias("u"), F.rand(3).alias("value"),
        F.timestamp_seconds(1_700_000_000 + F.col("id") * 7).cast("timestamp_ntz").alias("ts"),
    )
    rows.write.parquet(str(tmp_path / "events"))
    return tiny.read.parquet(str(tmp_path / "events"))


def final_plan(df):
    df.collect()
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue().split("== Initial Plan ==")[0]


def test_window_filter_splits_a_hot_unit(events):
    anchor = windows.anchors(events, "u", "ts", F.col("value") > 0.5)
    kept = windows.in_window(events, anchor, "u", "ts", "anchor_ts", -DAY, 10 * DAY)
    summed = kept.groupBy("u").agg(F.max("value").alias("top"))
    assert "skew=true" in final_plan(summed)
    plain = events.join(anchor, "u").filter(
        F.col("ts").between(F.col("anchor_ts") - F.expr("INTERVAL 1 DAY"), F.col("anchor_ts") + F.expr("INTERVAL 10 DAY"))
    ).groupBy("u").agg(F.max("value").alias("top"))
    assert sorted(summed.collect()) == sorted(plain.collect())


def test_peak_splits_a_hot_unit(events):
    spans = events.withColumn("stop", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    assert "skew=true" in final_plan(summaries.peak_within(spans, "u", "ts", "stop", "value", 24))


def test_code_table_splits_a_hot_code(events):
    table = events.select("u").distinct()
    table = lookups.stage(table)
    assert "skew=true" in final_plan(codes.in_codes(events, "u", table).select("event_id", "u"))


def test_asof_of_a_hot_unit_makes_no_pairs(events):
    probe = events.filter("event_id % 2 = 0").select("event_id", "u", "ts")
    ref = events.filter("value > 0.2").select("u", F.col("ts").alias("rts"), F.col("event_id").alias("rid"))
    got = lookups.asof_match(
        probe, ref, "u", "ts", "rts", dt.timedelta(hours=1), dt.timedelta(hours=1), ["rid"],
        tie=[F.col("rid")], rows_per_bucket=2000,
    )
    assert got.count() == 30_000
