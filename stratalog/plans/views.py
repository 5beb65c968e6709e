"""Drill-core shaped views of the given tables, in Spark and as SQL text.

events read as a scanner log: a user is a hole, hours since the first of
January 2024 are the depth, the event type is the mineral call (``error`` is the
reading that is no mineral). customer gives collars, orders give datasets and
revisions, embeddings give spectra.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.operators.ordered import number, ordered_scan
from stratalog.session import table

START_US = 1_704_067_200_000_000
LENGTH_H = 720.0
# sample numbers are unique per hole: a block of them bounds the rows of a task
SAMPLE_BLOCK = 65_536


def instant(column: str) -> Column:
    """A wall-clock column read as UTC, whatever the session's time zone."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(column)).cast("timestamp")


def order_of(us: Column, ident: Column) -> Column:
    """Time and id in one exact number."""
    return (us.cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)") + ident.cast("decimal(19,0)")).cast("decimal(38,0)")


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """events as readings: hole, event_id, us, seq, depth_h, call, event_type, value, k.

    ``seq`` is time and event id in one exact number: the order of readings.
    """
    events = table(spark, folder, "events")
    us = F.unix_micros(instant("ts"))
    return events.select(
        F.col("user_id").alias("hole"), "event_id", us.alias("us"),
        order_of(us, F.col("event_id")).alias("seq"), ((us - START_US) / 3.6e9).alias("depth_h"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("call"), "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def scan(spark: SparkSession, folder: str, hole=None) -> DataFrame:
    """readings with ``sample_no`` 0..n-1 per hole in depth order; of one hole only, if given."""
    rows = readings(spark, folder) if hole is None else readings(spark, folder).where(F.col("hole") == hole)
    numbered = ordered_scan(rows, ["hole"], ["us", "event_id"], {"sample_no": number()})
    return numbered.withColumn("sample_no", F.col("sample_no") - 1)


def sample_block(column: str = "sample_no"):
    return F.floor(F.col(column) / SAMPLE_BLOCK)


def intervals(samples: DataFrame, size: int, kind: str) -> DataFrame:
    """Closed sample ranges of ``size`` samples per hole, the last one shorter."""
    return samples.groupBy("hole", F.floor(F.col("sample_no") / size).cast("long").alias("ordinal")).agg(
        F.min("sample_no").alias("sample_no_from"), F.max("sample_no").alias("sample_no_to"),
        F.min("depth_h").alias("depth_min"), F.max("depth_h").alias("depth_max"),
    ).withColumn("kind", F.lit(kind))


def sites(spark: SparkSession, folder: str) -> DataFrame:
    """customer as collars on a fixed grid of positions."""
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        key.alias("hole_id"), F.col("c_name").alias("hole_name"), F.col("c_mktsegment").alias("project"), F.col("c_acctbal").alias("borehole_length_m"),
        (F.lit(115.0) + (key * 37 % 1400) / F.lit(100.0)).alias("longitude"), (F.lit(-35.0) + (key * 53 % 2000) / F.lit(100.0)).alias("latitude"),
    )


def members(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(base, incoming): latest order per customer before 1998 and from 1998 on, as dataset revisions."""
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("dataset_id"), F.col("o_orderkey").alias("dataset_revision_id"), F.col("o_orderdate").cast("date").alias("day")
    )
    old = F.col("day") < F.lit("1998-01-01").cast("date")
    latest = lambda df: df.groupBy("dataset_id").agg(F.max("dataset_revision_id").alias("dataset_revision_id"))
    return latest(orders.where(old)), latest(orders.where(~old))


def spectra(spark: SparkSession, folder: str) -> DataFrame:
    waves = F.sequence(F.lit(380), F.lit(380 + 63 * 4), F.lit(4))
    return table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("values"), "label", waves.alias("wavelengths"))


READINGS_SQL = """
readings AS (
  SELECT user_id AS hole, event_id, epoch_us(ts) AS us, (epoch_us(ts) - 1704067200000000) / 3.6e9 AS depth_h,
         CASE WHEN event_type <> 'error' THEN event_type END AS call, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events)"""
SCAN_SQL = READINGS_SQL + """,
scan AS (
  SELECT *, row_number() OVER (PARTITION BY hole ORDER BY us, event_id) - 1 AS sample_no FROM readings)"""
SITES_SQL = """
sites AS (
  SELECT c_custkey AS hole_id, c_name AS hole_name, c_mktsegment AS project, c_acctbal AS borehole_length_m,
         CAST(115.0 AS DOUBLE) + CAST(c_custkey * 37 % 1400 AS DOUBLE) / 100 AS longitude,
         CAST(-35.0 AS DOUBLE) + CAST(c_custkey * 53 % 2000 AS DOUBLE) / 100 AS latitude
  FROM customer)"""
MEMBERS_SQL = """
base AS (
  SELECT o_custkey AS dataset_id, max(o_orderkey) AS dataset_revision_id FROM orders
  WHERE CAST(o_orderdate AS DATE) < DATE '1998-01-01' GROUP BY 1),
incoming AS (
  SELECT o_custkey AS dataset_id, max(o_orderkey) AS dataset_revision_id FROM orders
  WHERE CAST(o_orderdate AS DATE) >= DATE '1998-01-01' GROUP BY 1)"""
INTERVALS_SQL = """
tray AS (
  SELECT hole, sample_no // 10 AS ordinal, min(sample_no) AS sample_no_from, max(sample_no) AS sample_no_to,
         min(depth_h) AS depth_min, max(depth_h) AS depth_max FROM scan GROUP BY 1, 2),
section AS (
  SELECT hole, sample_no // 5 AS ordinal, min(sample_no) AS sample_no_from, max(sample_no) AS sample_no_to,
         min(depth_h) AS depth_min, max(depth_h) AS depth_max FROM scan GROUP BY 1, 2)"""


def km_sql(lat1: str, lon1: str, lat2: str, lon2: str, radius: float = 6371.0088) -> str:
    return (
        f"2 * {radius} * asin(sqrt(least(power(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * power(sin((radians({lon2}) - radians({lon1})) / 2), 2), 1.0)))"
    )
