"""Model tables of the road analytics, derived from the given star-schema tables.

Each exists twice: as DataFrames, and as SQL common table expressions for the checks.
Times are seconds since 1970 in UTC (``t``, double) beside ``ts``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def seconds(ts: str) -> str:
    """SQL for seconds since 1970 of a zoneless timestamp, whatever the session's zone."""
    return f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts}) / 1000000D"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id AS camera_id", "CAST(event_id % 3 AS INT) AS direction_index", "ts", f"{seconds('ts')} AS t",
        "CASE event_type WHEN 'signup' THEN 'file' ELSE 'live' END AS source", "event_id * 0.5D AS video_time",
        "least(value / 200D, 1D) AS occupancy", "1000D * least(value / 200D, 1D) AS vehicle_px", "1000D AS road_px",
        "event_id % 7 AS n_car", "event_id % 2 AS n_bus", "event_id % 3 AS n_truck", "1 AS n_frames",
    )


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    rows = read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.selectExpr(
        "c_custkey AS id", "c_name AS name", "c_mktsegment AS route", "n_name AS region", "concat('S', c_custkey % 10) AS section",
        "33D + (c_custkey * 7919 % 1000) / 200D AS lat", "125D + (c_custkey * 104729 % 1000) / 200D AS lon",
        "c_acctbal > 0 AS enabled", "n_regionkey AS group_id",
    )


def directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").selectExpr("c_custkey", "explode(array(1, 2)) AS index").selectExpr(
        "c_custkey AS camera_id", "index", "concat('D', index) AS name",
        "CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat('R', c_custkey % 6) END AS road",
        "CAST((c_custkey * 37 + index * 180) % 360 AS DOUBLE) AS heading_deg",
    )


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "region").selectExpr("r_regionkey AS group_id", "r_name AS group_name")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cameras(spark, sf_dir).selectExpr("group_id", "id AS camera_id", "name AS label", "id AS order_no")


SQL = {
    "samples": """samples AS (
  SELECT event_id, user_id AS camera_id, CAST(event_id % 3 AS INT) AS direction_index, ts, epoch_us(ts) / 1000000.0::DOUBLE AS t,
    CASE event_type WHEN 'signup' THEN 'file' ELSE 'live' END AS source, event_id * 0.5::DOUBLE AS video_time,
    least(value / 200.0::DOUBLE, 1.0::DOUBLE) AS occupancy, 1000.0::DOUBLE * least(value / 200.0::DOUBLE, 1.0::DOUBLE) AS vehicle_px, 1000.0::DOUBLE AS road_px,
    event_id % 7 AS n_car, event_id % 2 AS n_bus, event_id % 3 AS n_truck, 1 AS n_frames
  FROM events)""",
    "cameras": """cameras AS (
  SELECT c_custkey AS id, c_name AS name, c_mktsegment AS route, n_name AS region, concat('S', c_custkey % 10) AS section,
    33.0::DOUBLE + (c_custkey * 7919 % 1000) / 200.0::DOUBLE AS lat, 125.0::DOUBLE + (c_custkey * 104729 % 1000) / 200.0::DOUBLE AS lon,
    c_acctbal > 0 AS enabled, n_regionkey AS group_id
  FROM customer JOIN nation ON c_nationkey = n_nationkey)""",
    "directions": """directions AS (
  SELECT c_custkey AS camera_id, i AS index, concat('D', i) AS name,
    CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat('R', c_custkey % 6) END AS road,
    CAST((c_custkey * 37 + i * 180) % 360 AS DOUBLE) AS heading_deg
  FROM customer, (VALUES (1), (2)) v(i))""",
    "members": """members AS (SELECT group_id, id AS camera_id, name AS label, id AS order_no FROM cameras)""",
}


def with_sql(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)


def level_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} < 0.08 THEN '원활' WHEN {x} < 0.15 THEN '서행' WHEN {x} < 0.25 THEN '지체' ELSE '정체' END"
