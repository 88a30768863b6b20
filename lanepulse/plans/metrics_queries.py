"""Queries of the sample analytics and group reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.levels import level
from ..operators import metrics as M
from .models import cameras, directions, level_sql, samples, with_sql

WEEK = 7 * 24 * 60
GAP = 2 * 86400.0

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


_NV = "n_car + n_bus + n_truck"
_LIVE_WEEK = "source = 'live' AND t >= (SELECT max(t) FROM samples) - 604800"
_MEANS = f"""means AS (SELECT camera_id, avg(occupancy) AS occ, max(occupancy) AS peak, avg({_NV}) AS nv, count(*) AS samples
  FROM samples WHERE {_LIVE_WEEK} AND direction_index = 0 GROUP BY camera_id)"""
_STATES = f"""states AS (SELECT camera_id, direction_index, t, occupancy, {_NV} AS nv, {level_sql("occupancy")} AS level
  FROM (SELECT *, row_number() OVER (PARTITION BY camera_id, direction_index ORDER BY t DESC, event_id DESC) AS r FROM samples) WHERE r = 1)"""
_LIVE = "live AS (SELECT c.id AS camera_id, name, route, region, section, enabled, t, occupancy, nv, level FROM cameras c LEFT JOIN states s ON c.id = s.camera_id AND s.direction_index = 0)"


@query("s1_sample_scan", with_sql("samples") + " SELECT camera_id, t, occupancy FROM samples WHERE source = 'live' AND direction_index = 0 AND t >= (SELECT max(t) FROM samples) - 604800")
def s1(spark: SparkSession, d: str) -> DataFrame:
    rows = samples(spark, d)
    return M.scan(rows, "live", M.latest_time(rows) - WEEK * 60, direction=0).select("camera_id", "t", "occupancy")


@query("s2_dimension_scan", with_sql("cameras", "directions") + " SELECT c.id AS camera_id, c.name, d.index AS direction_index, d.name AS direction_name FROM cameras c JOIN directions d ON c.id = d.camera_id")
def s2(spark, d):
    c, e = cameras(spark, d).select(F.col("id").alias("camera_id"), "name"), directions(spark, d)
    return c.join(e.select("camera_id", F.col("index").alias("direction_index"), F.col("name").alias("direction_name")), "camera_id").orderBy("camera_id", "direction_index")


@query("m1_level", with_sql("samples") + f" SELECT event_id, {level_sql('occupancy')} AS level FROM samples")
def m1(spark, d):
    return samples(spark, d).select("event_id", level(F.col("occupancy")).alias("level"))


def _history_sql(time: str, width: int, where: str) -> str:
    return with_sql("samples") + f""" SELECT *, {level_sql("occupancy")} AS level FROM (
  SELECT camera_id, direction_index, floor({time} / {width}) * {width} AS bucket, round(avg(occupancy), 10) AS occupancy, max(occupancy) AS max_occupancy,
    round(avg({_NV}), 10) AS nv, round(avg(n_car), 10) AS n_car, round(avg(n_bus), 10) AS n_bus, round(avg(n_truck), 10) AS n_truck,
    CAST(sum(n_frames) AS BIGINT) AS n_frames
  FROM samples WHERE {where} GROUP BY ALL)"""


@query("m2_history_live", _history_sql("t", 3600, _LIVE_WEEK))
def m2(spark, d):
    return M.history(M.since(samples(spark, d), WEEK), 3600.0)


@query("m3_history_file", _history_sql("video_time", 60, "source = 'file'"))
def m3(spark, d):
    return M.history(samples(spark, d).filter("source = 'file'"), 60.0, "video_time")


@query("m4_summary_by_direction", with_sql("samples", "cameras", "directions") + f""" SELECT s.camera_id, c.name AS camera_name, direction_index,
    CASE WHEN direction_index = 0 THEN '전체' ELSE coalesce(d.name, '방향 ' || direction_index) END AS direction_name,
    avg_occupancy, max_occupancy, nv, samples, {level_sql("avg_occupancy")} AS level
  FROM (SELECT camera_id, direction_index, round(avg(occupancy), 10) AS avg_occupancy, max(occupancy) AS max_occupancy, round(avg({_NV}), 10) AS nv, count(*) AS samples
    FROM samples WHERE {_LIVE_WEEK} GROUP BY ALL) s
  JOIN cameras c ON s.camera_id = c.id LEFT JOIN directions d ON d.camera_id = s.camera_id AND d.index = s.direction_index""")
def m4(spark, d):
    return M.summary_by_direction(M.since(samples(spark, d), WEEK), cameras(spark, d), directions(spark, d))


def _rollup_sql(by: str) -> str:
    return with_sql("samples", "cameras") + f", {_MEANS}" + f""" SELECT *, {level_sql("occupancy")} AS level FROM (
  SELECT coalesce(nullif({by}, ''), '(미지정)') AS group_name, round(avg(occ), 10) AS occupancy, round(max(occ), 10) AS max_occupancy, count(*) AS n_cameras, round(sum(nv), 10) AS nv
  FROM means JOIN cameras ON camera_id = id GROUP BY 1)"""


for _by in ("route", "region", "section"):

    @query(f"m5_rollup_{_by}", _rollup_sql(_by))
    def m5(spark, d, by=_by):
        return M.roll_up(M.since(samples(spark, d), WEEK), cameras(spark, d), by)


@query("m6_timeline", with_sql("samples") + f""" , s AS (SELECT * FROM samples WHERE {_LIVE_WEEK} AND direction_index = 0),
  b AS (SELECT camera_id, floor(t / 21600) * 21600 AS bucket, round(avg(occupancy) + 1e-9, 4) AS occupancy, round(avg({_NV}) + 1e-9, 2) AS nv FROM s GROUP BY ALL),
  g AS (SELECT camera_id, i * 21600.0::DOUBLE AS bucket FROM (SELECT DISTINCT camera_id FROM s),
    (SELECT unnest(range(CAST(floor((m - 604800) / 21600) AS BIGINT), CAST(floor(m / 21600) AS BIGINT) + 1)) AS i FROM (SELECT max(t) AS m FROM samples)))
  SELECT g.camera_id, g.bucket, occupancy, nv FROM g LEFT JOIN b ON g.camera_id = b.camera_id AND g.bucket = b.bucket""")
def m6(spark, d):
    rows = samples(spark, d)
    now = M.latest_time(rows)
    return M.timeline(M.since(rows, WEEK, as_of=now), 21600, now - WEEK * 60, now)


_EPISODES = f"""hi AS (SELECT *, occupancy >= 0.15 AS high, lag(occupancy >= 0.15) OVER w AS before, lag(t) OVER w AS previous
    FROM samples WHERE source = 'live' WINDOW w AS (PARTITION BY camera_id, direction_index ORDER BY t, event_id)),
  isl AS (SELECT *, sum(CASE WHEN high AND (coalesce(NOT before, true) OR t - previous > {GAP}) THEN 1 ELSE 0 END)
    OVER (PARTITION BY camera_id, direction_index ORDER BY t, event_id) AS island FROM hi),
  alerts AS (SELECT *, {level_sql("peak")} AS level, (SELECT max(t) FROM samples) - end_t < {GAP} AS ongoing FROM (
    SELECT camera_id, direction_index, min(t) AS start_t, max(t) AS end_t, max(occupancy) AS peak, round(avg(occupancy), 10) AS mean, round(avg({_NV}), 10) AS nv,
      count(*) AS samples, CAST(floor(max(t) - min(t)) AS BIGINT) AS duration_s
    FROM isl WHERE high GROUP BY camera_id, direction_index, island HAVING count(*) >= 2 AND max(t) - min(t) >= 30))"""


def _alerts(spark, d):
    rows = samples(spark, d)
    return M.episodes(rows.filter("source = 'live'"), gap=GAP, as_of=M.latest_time(rows))


@query("m7_alert_episodes", with_sql("samples") + f", {_EPISODES} SELECT * FROM alerts")
def m7(spark, d):
    return _alerts(spark, d)


@query("m7_alerts_newest", with_sql("samples") + f", {_EPISODES} SELECT *, (SELECT count(*) FROM alerts) AS total FROM alerts ORDER BY start_t DESC, camera_id, direction_index LIMIT 200")
def m7b(spark, d):
    return M.newest(_alerts(spark, d))


@query("m8_heatmap", with_sql("samples") + """, l AS (SELECT CAST(floor(t + 32400) AS BIGINT) AS k, occupancy FROM samples WHERE source = 'live' AND direction_index = 0),
  b AS (SELECT (k // 86400 + 3) % 7 AS weekday, k % 86400 // 3600 AS hour, round(avg(occupancy) + 1e-9, 4) AS occupancy FROM l GROUP BY ALL),
  g AS (SELECT CAST(i // 24 AS INT) AS weekday, CAST(i % 24 AS INT) AS hour FROM range(168) r(i))
  SELECT g.weekday, g.hour, occupancy FROM g LEFT JOIN b USING (weekday, hour)""")
def m8(spark, d):
    return M.heatmap(samples(spark, d).filter("source = 'live'"))


@query("w3_latest_state", with_sql("samples") + f", {_STATES} SELECT * FROM states")
def w3(spark, d):
    return M.latest_states(samples(spark, d))


def _live(spark, d):
    return M.live_table(samples(spark, d), cameras(spark, d))


@query("m9_live_table", with_sql("samples", "cameras") + f", {_STATES}, {_LIVE} SELECT * FROM live")
def m9(spark, d):
    return _live(spark, d)


@query("m10_kpis", with_sql("samples", "cameras") + f""", {_STATES}, {_LIVE} SELECT count(*) FILTER (enabled) AS running, round(avg(occupancy), 10) AS mean_occupancy,
  count(*) FILTER (level IN ('지체', '정체')) AS congested, CAST(sum(nv) AS BIGINT) AS vehicles,
  (SELECT camera_id FROM live WHERE occupancy IS NOT NULL ORDER BY occupancy DESC, camera_id LIMIT 1) AS worst_camera FROM live""")
def m10(spark, d):
    return M.kpis(_live(spark, d))


@query("m11_trend", with_sql("samples", "cameras") + f""", {_STATES}, {_LIVE}, {_MEANS}
  SELECT camera_id, diff, CASE WHEN abs(diff) < 0.01 THEN 'flat' WHEN diff > 0 THEN 'up' ELSE 'down' END AS trend FROM (
  SELECT l.camera_id, round(occupancy - occ, 10) AS diff FROM live l JOIN means m ON l.camera_id = m.camera_id WHERE occupancy IS NOT NULL)""")
def m11(spark, d):
    return M.trend(_live(spark, d), M.camera_means(M.since(samples(spark, d), WEEK)))


@query("m12_history_wide", with_sql("samples") + """, h AS (SELECT camera_id, direction_index, floor(t / 86400) * 86400 AS bucket, round(avg(occupancy), 10) AS o FROM samples GROUP BY ALL)
  SELECT camera_id, bucket, max(o) FILTER (direction_index = 0) AS d0, max(o) FILTER (direction_index = 1) AS d1, max(o) FILTER (direction_index = 2) AS d2 FROM h GROUP BY camera_id, bucket""")
def m12(spark, d):
    h = samples(spark, d).groupBy("camera_id", "direction_index", M.bucket("t", 86400).alias("bucket")).agg(F.round(F.avg("occupancy"), 10).alias("occupancy"))
    return M.history_wide(h.withColumn("series", F.concat(F.lit("d"), F.col("direction_index").cast("string"))), ["d0", "d1", "d2"], "camera_id")


@query("m13_group_series", with_sql("samples", "cameras") + f""", {_MEANS},
  top AS (SELECT region FROM means JOIN cameras ON camera_id = id GROUP BY region ORDER BY round(avg(occ), 10) DESC, region LIMIT 8),
  b AS (SELECT camera_id, floor(t / 86400) * 86400 AS bucket, round(avg(occupancy) + 1e-9, 4) AS occupancy FROM samples WHERE {_LIVE_WEEK} AND direction_index = 0 GROUP BY ALL)
  SELECT region AS group_name, bucket, round(avg(occupancy), 10) AS occupancy FROM b JOIN cameras ON camera_id = id WHERE region IN (SELECT region FROM top) GROUP BY ALL""")
def m13(spark, d):
    rows = M.since(samples(spark, d), WEEK)
    top = M.sort_groups(M.roll_up(rows, cameras(spark, d), "region")).filter("place <= 8").select("group_name")
    line = rows.filter("direction_index = 0").groupBy("camera_id", M.bucket("t", 86400).alias("bucket")).agg(F.round(F.avg("occupancy") + 1e-9, 4).alias("occupancy"))
    return M.group_series(line, cameras(spark, d), "region", top)


@query("m14_sort_groups", with_sql("samples", "cameras") + f""", {_MEANS}, g AS (SELECT region AS group_name, round(avg(occ), 10) AS occupancy, round(sum(nv), 10) AS nv FROM means JOIN cameras ON camera_id = id GROUP BY 1)
  SELECT group_name, nv, row_number() OVER (ORDER BY coalesce(nv, -1) DESC, group_name) AS place FROM g""")
def m14(spark, d):
    return M.sort_groups(M.roll_up(M.since(samples(spark, d), WEEK), cameras(spark, d), "region"), "nv").select("group_name", "nv", F.col("place").cast("long"))


@query("m15_stats_header", with_sql("samples") + f", {_MEANS}, {_EPISODES} SELECT (SELECT round(avg(occ), 10) FROM means) AS mean_occupancy, (SELECT count(*) FROM means) AS cameras, count(*) AS alerts, count(*) FILTER (ongoing) AS ongoing FROM alerts")
def m15(spark, d):
    return M.stats_header(M.camera_means(M.since(samples(spark, d), WEEK)), _alerts(spark, d))


for _name, _by_dir, _cond in (("m16_ranking_points", False, "= 0"), ("m16_ranking_directions", True, "> 0")):

    @query(_name, with_sql("samples") + f", {_STATES} SELECT camera_id, direction_index, occupancy, level, row_number() OVER (ORDER BY occupancy DESC, camera_id, direction_index) AS place FROM states WHERE direction_index {_cond}")
    def m16(spark, d, by_dir=_by_dir):
        return M.ranking(M.latest_states(samples(spark, d)), by_dir).withColumn("place", F.col("place").cast("long"))


@query("m17_level_counts", with_sql("samples") + f""", {_STATES}, lv(level_no, level) AS (VALUES (0, '원활'), (1, '서행'), (2, '지체'), (3, '정체'))
  SELECT level_no, lv.level, count(s.camera_id) AS points FROM lv LEFT JOIN (SELECT * FROM states WHERE direction_index = 0) s ON lv.level = s.level GROUP BY ALL""")
def m17(spark, d):
    return M.level_counts(M.latest_states(samples(spark, d)).filter("direction_index = 0"))


@query("m18_needs_setup", with_sql("cameras", "directions", "samples") + """ SELECT id FROM cameras WHERE id IN (SELECT d.camera_id FROM directions d
  WHERE heading_deg < 120 AND EXISTS (SELECT 1 FROM samples s WHERE s.camera_id = d.camera_id AND s.direction_index = d.index))""")
def m18(spark, d):
    # a heading below 120 stands for a missing one
    dirs = directions(spark, d).withColumn("heading_deg", F.when(F.col("heading_deg") >= 120, F.col("heading_deg")))
    seen = samples(spark, d).select("camera_id", F.col("direction_index").alias("index")).distinct()
    return M.needs_setup(cameras(spark, d), dirs, seen).select("id")


@query("m19_filter_cameras", with_sql("samples", "cameras") + f", {_STATES}, {_LIVE} SELECT camera_id, name, occupancy FROM live WHERE enabled AND lower(concat_ws(' ', name, route, region, section)) LIKE '%s1%' AND route = 'BUILDING'")
def m19(spark, d):
    return M.filter_cameras(_live(spark, d), "S1", "BUILDING", True).select("camera_id", "name", "occupancy")


@query("m20_filter_points", with_sql("samples") + f", {_STATES} SELECT camera_id, count(*) AS n_states FROM states GROUP BY camera_id HAVING count(*) FILTER (level = '정체') > 0")
def m20(spark, d):
    return M.filter_points(M.latest_states(samples(spark, d)), "정체")


@query("m21_measured", with_sql("cameras", "directions") + " SELECT camera_id, index, (camera_id + index) % 3 > 0 AS measured FROM directions")
def m21(spark, d):
    # a map of painted pixels per direction, as in a camera's meta column
    px = F.create_map(F.lit("1"), (F.col("camera_id") + 1) % 3, F.lit("2"), (F.col("camera_id") + 2) % 3)
    return directions(spark, d).select("camera_id", "index", M.measured(px, F.col("index")).alias("measured"))


@query("m23_by_road", with_sql("directions") + " SELECT camera_id, coalesce(nullif(trim(road), ''), '(도로 미지정)') AS road, string_agg(CAST(index AS VARCHAR), ',' ORDER BY index) AS indexes FROM directions GROUP BY 1, 2")
def m23(spark, d):
    return M.by_road(directions(spark, d))
