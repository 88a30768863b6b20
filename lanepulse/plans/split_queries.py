"""Queries of quotas, role choice and the split, with their SQL.

Frames are line items: suppliers are cameras, each with one to seven clips by line number; conditions
belong to a clip."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.kept import kept, spent
from ..operators import split as S
from .models import read

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


_ONE = "SELECT l_suppkey AS s, l_linenumber % (1 + l_suppkey % 7) AS k, l_orderkey AS o, l_linenumber AS l, min(l_partkey) AS p FROM lineitem GROUP BY l_suppkey, l_orderkey, l_linenumber"
_COND = """CASE (s + k) % 3 WHEN 0 THEN 'day' WHEN 1 THEN 'night' ELSE 'twilight' END AS day_night, CASE (s + 2 * k) % 4 WHEN 0 THEN 'rainy' WHEN 1 THEN 'fog' ELSE 'sunny' END AS weather,
  CASE WHEN s % 6 = 0 THEN 'tunnel' ELSE 'general' END AS road_form, CAST((s + k) % 5 AS TEXT) AS time_band, CAST((s * 3 + k) % 7 AS TEXT) AS weekday, CASE WHEN k % 2 = 0 THEN 'NH' ELSE 'RH' END AS hour_type, CAST(s * k % 11 AS TEXT) AS date"""
_FRAME = "s AS camera, concat(s, '_', k) AS clip, concat(o, '-', l, '-', s) AS image_id, o AS frame, p % 7 AS n_car, CASE WHEN p % 3 = 0 THEN 2 ELSE 0 END AS n_bus, CASE WHEN p % 5 = 0 THEN 1 ELSE 0 END AS n_truck"
_FRAMES = f"""one AS ({_ONE}), f0 AS (SELECT {_FRAME}, {_COND} FROM one),
  frames AS (SELECT *, CASE WHEN day_night = 'day' AND weather = 'sunny' AND road_form = 'general' THEN 'easy' ELSE 'hard' END AS difficulty FROM f0)"""


def frames(spark, d):
    read(spark, d, "lineitem").createOrReplaceTempView("_split_lineitem")
    sql = _FRAMES.replace("FROM lineitem", "FROM _split_lineitem").replace("AS TEXT", "AS STRING")
    return spark.sql(f"WITH {sql} SELECT * FROM frames")


def _rounds(source: str, total: str, minimum: int, by: str = "") -> str:
    """Recursive SQL over ``source`` (key, w, cap): a round of shares a step."""
    over = f"OVER (PARTITION BY {by})" if by else "OVER ()"
    also, rank = (f"{by}, ", f"{by}, ") if by else ("", "")
    return f"""r(step, {also}key, w, cap, total, n) AS (
  SELECT 0, {also}key, w, cap, {total}, CASE WHEN w > 0 AND {minimum} * heavy <= {total} THEN least({minimum}, cap) ELSE 0 END FROM (SELECT *, count(*) FILTER (w > 0) {over} AS heavy FROM {source})
  UNION ALL SELECT step + 1, {also}key, w, cap, total, CAST(n + extra + CASE WHEN more AND row_number() OVER (PARTITION BY {rank}more ORDER BY rest DESC, key) <= rem - extras THEN 1 ELSE 0 END AS BIGINT) FROM (
    SELECT *, live AND n + extra < cap AS more, sum(extra) {over} AS extras FROM (
      SELECT * REPLACE (CASE WHEN sum(extra) {over} > rem THEN CAST(extra AS HUGEINT) * rem // CAST(sum(extra) {over} AS HUGEINT) ELSE extra END AS extra) FROM (
        SELECT *, CASE WHEN live THEN (rem + open_n) * CAST(w AS HUGEINT) - base * open_w END AS rest, CASE WHEN live THEN least(greatest(base - n, 0), cap - n) ELSE 0 END AS extra FROM (
          SELECT *, CASE WHEN live THEN (rem + open_n) * CAST(w AS HUGEINT) // open_w END AS base FROM (
            SELECT *, rem > 0 AND w > 0 AND n < cap AS live FROM (
              SELECT *, total - CAST(sum(n) {over} AS BIGINT) AS rem, CAST(sum(CASE WHEN w > 0 AND n < cap THEN n END) {over} AS HUGEINT) AS open_n, CAST(sum(CASE WHEN w > 0 AND n < cap THEN w END) {over} AS HUGEINT) AS open_w FROM r)))))
    QUALIFY bool_or(live) OVER ()))"""


_BRANDS = "b AS (SELECT p_brand AS key, CAST(sum(p_size) AS BIGINT) AS w, 1099511627776 AS cap FROM part GROUP BY 1)"


@query("x1_apportion", f"WITH RECURSIVE {_BRANDS}, {_rounds('b', '1000', 0)} SELECT key, n FROM r WHERE step = (SELECT max(step) FROM r)")
def x1(spark, d):
    return S.apportion(read(spark, d, "part").groupBy(F.col("p_brand").alias("key")).agg(F.sum("p_size").alias("weight")), 1000)


_CAPPED = "b AS (SELECT c_custkey AS key, CAST(c_custkey % 13 * (c_custkey % 13) AS BIGINT) AS w, CASE WHEN c_custkey % 13 > 9 THEN 3 + c_custkey % 4 ELSE 60 END AS cap FROM customer)"


@query("x1_apportion_capped", f"WITH RECURSIVE {_CAPPED}, {_rounds('b', '(SELECT 20 * count(*) FROM customer)', 2)} SELECT key, n FROM r WHERE step = (SELECT max(step) FROM r)")
def x1c(spark, d):
    rows = read(spark, d, "customer").selectExpr("c_custkey AS key", "c_custkey % 13 * (c_custkey % 13) AS weight", "CASE WHEN c_custkey % 13 > 9 THEN 3 + c_custkey % 4 ELSE 60 END AS cap")
    return S.apportion(rows, 20 * rows.count(), 2)


_GROUPED = "b AS (SELECT l_suppkey AS g, l_partkey % 9 AS key, count(*) AS w, CASE l_partkey % 9 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 5 + l_suppkey % 30 END AS cap, l_suppkey % 50 AS tot FROM lineitem GROUP BY ALL)"


@query("x1_apportion_grouped", f"WITH RECURSIVE {_GROUPED}, {_rounds('b', 'tot', 1, 'g')} SELECT g, key, n FROM r WHERE step = (SELECT max(step) FROM r)")
def x1g(spark, d):
    rows = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("g"), F.expr("l_partkey % 9").alias("key")).agg(F.count("*").alias("weight"))
    rows = rows.withColumns({"cap": F.expr("CASE key WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 5 + g % 30 END"), "total": F.expr("g % 50")})
    return S.apportion(rows, "total", 1, ("g",))


_OPTIONS = f"""{_FRAMES}, c0 AS (SELECT camera, clip, count(*) AS size, avg(CAST(difficulty = 'hard' AS INT)) AS hard, min(day_night) AS day_night, min(weather) AS weather, min(difficulty) AS difficulty, min(time_band) AS time_band, min(weekday) AS weekday, min(hour_type) AS hour_type, min(date) AS date,
    avg(n_car) AS car, avg(n_bus) AS bus, avg(n_truck) AS truck FROM frames GROUP BY ALL), c AS (SELECT *, count(*) OVER (PARTITION BY camera) AS clips FROM c0),
  q AS (SELECT camera, 3 + camera % 40 AS qv, 20 + camera % 90 AS qt FROM frames GROUP BY camera), tt AS (SELECT CAST(sum(qv) AS BIGINT) AS tv, CAST(sum(qt) AS BIGINT) AS ts FROM q), hh AS (SELECT count(*) AS h FROM frames WHERE difficulty = 'hard'),
  o0 AS (SELECT v.camera, 'separate' AS mode, v.clip AS val, [t.clip] AS test, v.size AS avail_val, t.size AS avail_test, v.size AS sv, v.hard AS hv, [t.size] AS st, [t.hard] AS ht FROM c v JOIN c t ON v.camera = t.camera AND v.clip <> t.clip WHERE v.clips >= 3
    UNION ALL SELECT v.camera, 'separate', v.clip, [t.clip, u.clip], v.size, t.size + u.size, v.size, v.hard, [t.size, u.size], [t.hard, u.hard] FROM c v JOIN c t ON v.camera = t.camera AND v.clip <> t.clip JOIN c u ON v.camera = u.camera AND u.clip <> v.clip AND t.clip < u.clip WHERE v.clips >= 4
    UNION ALL SELECT c.camera, CASE clips WHEN 2 THEN 'same_clip' ELSE 'single_clip' END, clip, [clip], greatest(1, size - least(qt, size - 1)), greatest(1, size - least(qv, size - 1)), size, hard, NULL, NULL FROM c JOIN q USING (camera) WHERE clips < 3),
  o1 AS (SELECT *, least(qv, avail_val) AS ev, least(qt, avail_test) AS et FROM o0 JOIN q USING (camera)),
  o AS (SELECT *, 5.0::DOUBLE * ((qv - ev)::DOUBLE / greatest(1, tv) + (qt - et)::DOUBLE / greatest(1, ts)) + 3.0::DOUBLE * CASE mode WHEN 'single_clip' THEN 0 WHEN 'same_clip' THEN (sv - ev - et) * hv
    ELSE (sv - ev) * hv + list_sum(list_transform(range(1, len(st) + 1), lambda i: (st[i] - et * st[i] / list_sum(st)::DOUBLE) * ht[i])) END / greatest(1, h) AS penalty FROM o1, tt, hh)"""


def _quotas(rows):
    return rows.select("camera").distinct().selectExpr("camera", "3 + camera % 40 AS val", "20 + camera % 90 AS test")


def _options(spark, d):
    rows = kept(frames(spark, d), "frames")
    clips = kept(S.clip_table(rows), "clips")
    return rows, clips, S.role_options(clips, _quotas(rows), rows.filter("difficulty = 'hard'").count())


@query("x5_role_options", f"WITH {_OPTIONS} SELECT camera, mode, val, array_to_string(test, '+') AS test, avail_val, avail_test, ev, et, round(penalty, 9) AS penalty FROM o")
def x5(spark, d):
    options = _options(spark, d)[2]
    return options.select("camera", "mode", "val", F.array_join("test", "+").alias("test"), "avail_val", "avail_test", "ev", "et", F.round("penalty", 9).alias("penalty"))


_LONG = "UNPIVOT (SELECT clip, day_night, weather, difficulty, time_band, weekday, hour_type, date FROM c) ON day_night, weather, difficulty, time_band, weekday, hour_type, date INTO NAME attribute VALUE value"


@query("x5_option_features", f"""WITH {_OPTIONS}, has AS (SELECT *, 1.0::DOUBLE AS x FROM ({_LONG}) UNION ALL SELECT clip, 'class', cls, x FROM (UNPIVOT (SELECT clip, car, bus, truck FROM c) ON car, bus, truck INTO NAME cls VALUE x)),
  p AS (SELECT camera, val, test, val AS clip, CAST(ev AS DOUBLE) AS v, 0.0::DOUBLE AS t FROM o UNION ALL SELECT o.camera, val, o.test, t.clip, 0, et * size / (SELECT sum(size) FROM c x WHERE list_contains(o.test, x.clip))::DOUBLE FROM o, unnest(o.test) t(clip) JOIN c USING (clip))
  SELECT camera, val, array_to_string(test, '+') AS test, attribute, value, round(sum(v * x), 6) AS in_val, round(sum(t * x), 6) AS in_test FROM p JOIN has USING (clip) GROUP BY ALL""")
def x5f(spark, d):
    rows, clips, options = _options(spark, d)
    out = S.option_features(options, clips, S.clip_features(clips, S.feature_table(rows)))
    return out.select("camera", "val", F.array_join("test", "+").alias("test"), "attribute", "value", F.round("in_val", 6).alias("in_val"), F.round("in_test", 6).alias("in_test"))


@query("x6_choose_roles")
def x6(spark, d):
    rows, clips, options = _options(spark, d)
    features = S.feature_table(rows)
    plan = S.choose_roles(options, clips, features, S.clip_features(clips, features), restarts=8, seed=42)
    return plan.select("camera", "mode", "val", F.array_join("test", "+").alias("test"), "ev", "et", F.round("penalty", 9).alias("penalty"), F.round("cost", 9).alias("cost"))


def _split(spark, d):
    rows = kept(frames(spark, d), "frames")
    n = rows.count()
    sets = S.split_frames(rows, n // 10, n // 5, n // 2, restarts=4, seed=42)[0]
    spent(rows)
    return sets


@query("x10_split_frames")
def x10(spark, d):
    return _split(spark, d)


@query("x10_split_clips")
def x10c(spark, d):
    return S.split_clips(_split(spark, d))


_SETS = "s AS (SELECT l_suppkey AS clip, l_orderkey AS frame, CASE l_partkey % 5 WHEN 0 THEN 'val' WHEN 1 THEN 'test' WHEN 2 THEN '' ELSE 'train' END AS split FROM lineitem WHERE l_suppkey % 3 > 0 OR l_partkey % 5 < 1)"


def _sets(spark, d):
    rows = read(spark, d, "lineitem").filter("l_suppkey % 3 > 0 OR l_partkey % 5 < 1")
    return rows.selectExpr("l_suppkey AS clip", "l_orderkey AS frame", "CASE l_partkey % 5 WHEN 0 THEN 'val' WHEN 1 THEN 'test' WHEN 2 THEN '' ELSE 'train' END AS split")


@query("x12_leakage_check", f"""WITH {_SETS}, g AS (SELECT a.split AS set_a, b.split AS set_b, clip, min(abs(a.frame - b.frame)) AS gap FROM s a JOIN s b USING (clip)
  WHERE list_position(['train', 'val', 'test'], a.split) < list_position(['train', 'val', 'test'], b.split) GROUP BY ALL) SELECT set_a, set_b, count(*) AS clips, min(gap) AS min_gap, CAST(quantile_cont(gap, 0.5) AS DOUBLE) AS median_gap FROM g GROUP BY ALL""")
def x12(spark, d):
    return S.leakage_pairs(_sets(spark, d))


@query("x12_leakage_clips", f"WITH {_SETS} SELECT clip, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM s WHERE split <> '' GROUP BY 1 HAVING count(DISTINCT split) > 1")
def x12c(spark, d):
    return S.leakage_clips(_sets(spark, d))
