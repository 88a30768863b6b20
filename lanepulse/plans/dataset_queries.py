"""Queries of the manifest, dataset statistics and split operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.kept import work_folder
from ..operators import coverage as C
from ..operators import dataset as D
from ..operators import manifest as N
from .models import read

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


_PICK = {
    "site": "CASE o_custkey % 4 WHEN 0 THEN 'Suwon' WHEN 1 THEN 'Busan' WHEN 2 THEN 'Inje' ELSE 'Seoul' END",
    "channel": "CASE o_custkey % 6 WHEN 0 THEN 'injetunnel2' WHEN 1 THEN 'busanportbrdg1' WHEN 2 THEN 'xoverpass' ELSE concat('CH', o_custkey % 9) END",
    "weather": "CASE o_custkey % 5 WHEN 0 THEN 'rainy' WHEN 1 THEN 'fog' ELSE 'sunny' END",
    "hour_type": "CASE WHEN o_orderkey % 2 = 0 THEN 'NH' ELSE 'RH' END",
    "hh": "CAST(7 + o_orderkey % 15 AS STRING)",
}


def _clip(date: str, text: str) -> str:
    p = {k: v.replace("STRING", text) for k, v in _PICK.items()}
    tail = f"CASE WHEN o_orderkey % 50 = 0 THEN 'FHD_x' ELSE 'FHD' END"
    return f"concat({p['site']}, '_', {p['channel']}, '_', {date}, '_', lpad({p['hh']}, 2, '0'), '30_MON_9m_', {p['hour_type']}, '_highway_TW5_', {p['weather']}, '_', {tail})"


#: Where the manifest of a table folder is kept, by application.
_KEPT: dict[tuple[str, str], str] = {}


#: Images that a task parses, about.
TASK_ROWS = 100_000


def parsed(spark, d):
    """Images with the parts of their clip's name; a small file holds many, so they are dealt out before they are parsed."""
    orders = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), orders.count() // TASK_ROWS + 1)
    rows = orders.repartition(parts, "o_orderkey").selectExpr(
        f"{_clip(chr(39).join(['date_format(o_orderdate, ', 'yyyyMMdd', ')']), 'STRING')} AS clip", "o_orderkey AS image_id", "o_orderkey % 100 AS frame", "o_orderkey % 7 AS n_car", "o_orderkey % 3 AS n_bus", "o_orderkey % 2 AS n_truck", "o_totalprice / 1000000D AS ratio",
        "CASE o_orderkey % 5 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split", "o_totalprice AS score",
    )
    return N.parse_clip(rows)


def conditioned(spark, d):
    return N.conditions(parsed(spark, d))


def manifest(spark, d):
    """The manifest with its conditions, assembled once an application and folder; queries read their columns of it."""
    key = spark.sparkContext.applicationId, d.rstrip("/")
    path = _KEPT.get(key)
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return spark.read.parquet(path)
    _KEPT[key] = path = work_folder(spark, "manifest")
    conditioned(spark, d).write.parquet(path)
    return spark.read.parquet(path)


_M = f"""WITH m0 AS (SELECT {_clip("strftime(o_orderdate, '%Y%m%d')", "VARCHAR")} AS clip, o_orderkey AS image_id, o_orderkey % 100 AS frame, o_orderkey % 7 AS n_car, o_orderkey % 3 AS n_bus, o_orderkey % 2 AS n_truck, o_totalprice / 1000000.0::DOUBLE AS ratio,
    CASE o_orderkey % 5 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split, o_totalprice AS score FROM orders),
  m1 AS (SELECT *, string_split(clip, '_') AS t, len(string_split(clip, '_')) = 11 AS meta_parsed FROM m0),
  m2 AS (SELECT *, CASE WHEN meta_parsed THEN t[1] ELSE '' END AS site, CASE WHEN meta_parsed THEN t[2] ELSE '' END AS channel, CASE WHEN meta_parsed THEN t[3] ELSE '' END AS date, CASE WHEN meta_parsed THEN t[4] ELSE '' END AS time,
    CASE WHEN meta_parsed THEN t[7] ELSE '' END AS hour_type, CASE WHEN meta_parsed THEN t[10] ELSE '' END AS weather, CASE WHEN meta_parsed THEN t[1] || '_' || t[2] ELSE '' END AS camera FROM m1),
  m3 AS (SELECT *, TRY_CAST(substr(time, 1, 2) AS INT) AS hr, TRY_CAST(substr(time, 1, 2) AS INT) * 60 + TRY_CAST(substr(time, 3, 2) AS INT) AS mins,
    CASE site WHEN 'Suwon' THEN 37.26::DOUBLE WHEN 'Busan' THEN 35.18::DOUBLE WHEN 'Inje' THEN 38.07::DOUBLE ELSE 36.5::DOUBLE END AS la, CASE site WHEN 'Suwon' THEN 127.03::DOUBLE WHEN 'Busan' THEN 129.08::DOUBLE WHEN 'Inje' THEN 128.17::DOUBLE ELSE 127.8::DOUBLE END AS lo,
    (dayofyear(try_strptime(date, '%Y%m%d')) - 1) * (2 * pi() / 365) AS g FROM m2),
  m4 AS (SELECT *, 229.18::DOUBLE * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) AS eq,
    0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) AS tilt FROM m3),
  m5 AS (SELECT *, degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, cos(radians(90.833::DOUBLE)) / (cos(radians(la)) * cos(tilt)) - tan(radians(la)) * tan(tilt))))) AS half, 720 - 4 * lo - eq + 540 AS noon FROM m4),
  m6 AS (SELECT *, noon - 4 * half AS rise, noon + 4 * half AS fall FROM m5),
  m AS (SELECT *, CASE WHEN mins IS NULL OR g IS NULL THEN '' WHEN mins >= rise + 30 AND mins < fall - 30 THEN 'day' WHEN abs(mins - rise) <= 30 OR abs(mins - fall) <= 30 THEN 'twilight' ELSE 'night' END AS day_night,
    CASE WHEN channel LIKE '%tunnel%' THEN 'tunnel' WHEN channel LIKE '%brdg%' THEN 'bridge' WHEN channel LIKE '%overpass%' THEN 'overpass' ELSE 'general' END AS road_form,
    CASE WHEN hr IS NULL THEN '' WHEN hr BETWEEN 7 AND 9 THEN '07-09' WHEN hr BETWEEN 10 AND 12 THEN '10-12' WHEN hr BETWEEN 13 AND 15 THEN '13-15' WHEN hr BETWEEN 16 AND 18 THEN '16-18' WHEN hr BETWEEN 19 AND 21 THEN '19-21' ELSE 'other' END AS time_band FROM m6),
  mm AS (SELECT *, concat_ws('|', CASE WHEN day_night <> 'day' THEN 'day_night=' || day_night END, CASE WHEN weather <> 'sunny' THEN 'weather=' || weather END, CASE WHEN road_form <> 'general' THEN 'road_form=' || road_form END) AS hard_reasons FROM m),
  man AS (SELECT *, CASE WHEN hard_reasons = '' THEN 'easy' ELSE 'hard' END AS difficulty FROM mm)"""


@query("t2_parse_clip", _M + " SELECT image_id, meta_parsed, site, channel, camera, weather, CASE WHEN meta_parsed THEN 9.0::DOUBLE END AS cam_height_m, CASE WHEN meta_parsed THEN 'two_way' ELSE '' END AS lane_direction, CASE WHEN meta_parsed THEN 5 END AS lane_count FROM man")
def t2(spark, d):
    return parsed(spark, d).select("image_id", "meta_parsed", "site", "channel", "camera", "weather", "cam_height_m", "lane_direction", "lane_count")


@query("t3_t7_conditions", _M + " SELECT image_id, time_band, day_night, road_form, hard_reasons, difficulty FROM man")
def t37(spark, d):
    return conditioned(spark, d).select("image_id", "time_band", "day_night", "road_form", "hard_reasons", "difficulty")


@query("t4_sun_times", _M + " SELECT image_id, round(rise, 6) AS sunrise, round(fall, 6) AS sunset FROM man")
def t4(spark, d):
    rise, fall = N.sun_minutes(F.try_to_timestamp("date", F.lit("yyyyMMdd")).cast("date"), F.col("site"))
    return parsed(spark, d).select("image_id", F.round(rise, 6).alias("sunrise"), F.round(fall, 6).alias("sunset"))


_ATTRS = ("site", "camera", "road_form", "day_night", "weather", "difficulty", "time_band", "hour_type", "date", "hard_reasons")
_ATTR = ", ".join(_ATTRS)


@query("t16_distributions", _M + f" SELECT attribute, value, count(*) AS n FROM (UNPIVOT (SELECT {_ATTR} FROM man) ON {_ATTR} INTO NAME attribute VALUE value) GROUP BY ALL")
def t16(spark, d):
    return N.distributions(manifest(spark, d), list(_ATTRS))


def _points(spark, d):
    xy = lambda k: F.struct(F.col("embedding")[2 * k].cast("double").alias("x"), F.col("embedding")[2 * k + 1].cast("double").alias("y"))
    return read(spark, d, "embeddings").select("vec_id", "label", F.array(*[xy(k) for k in range(8)]).alias("points"))


def _terms(f: str) -> str:
    return " + ".join(f.format(x=f"e[{2 * k + 1}]", y=f"e[{2 * k + 2}]", u=f"e[{2 * ((k + 1) % 8) + 1}]", v=f"e[{2 * ((k + 1) % 8) + 2}]") for k in range(8))


@query("t8_polygon_area", f"""WITH p AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT vec_id, {_terms('({x} * {v} - {u} * {y})')} AS t,
  {_terms('({x} * {v} - {u} * {y}) * ({x} + {u})')} AS sx, {_terms('({x} * {v} - {u} * {y}) * ({y} + {v})')} AS sy FROM p)
  SELECT vec_id, round(abs(t) / 2, 9) AS area, round(sx / (3 * t), 6) AS cx, round(sy / (3 * t), 6) AS cy FROM s""")
def t8(spark, d):
    rows = _points(spark, d).select("vec_id", N.polygon_area_centroid(F.col("points")).alias("a"))
    return rows.select("vec_id", F.round("a.area", 9).alias("area"), F.round("a.cx", 6).alias("cx"), F.round("a.cy", 6).alias("cy"))


@query("t9_t10_label_lines")
def t910(spark, d):
    """Label files of images of four polygons each; some of a class that is not known, some too small."""
    far = F.when(F.col("vec_id") % 5 == 0, 0.5).otherwise(90.0)
    moved = F.transform("points", lambda p: F.struct(((p["x"] * far) + 50).alias("x"), ((p["y"] * far) + 50).alias("y")))
    label = F.when(F.col("vec_id") % 7 == 0, "bicycle").otherwise(F.get(F.array(*map(F.lit, D.CLASSES)), (F.col("label") % 3).cast("int")))
    rows = _points(spark, d).select(F.expr("vec_id div 4").alias("image_id"), F.col("vec_id").alias("ord"), label.alias("label"), moved.alias("points"))
    return N.label_lines(rows, D.CLASSES, 100.0, 100.0, 1.0)


_FILES = """WITH i AS (SELECT l_orderkey AS key, concat(CASE WHEN l_linenumber % 2 = 0 THEN 'a/b/' ELSE 'a/' END, l_orderkey, '_', l_partkey, '.jpg') AS path FROM lineitem WHERE l_orderkey % 3 > 0),
  b AS (SELECT o_orderkey AS key, concat('x/', o_orderkey, '.xml') AS path, o_custkey AS ord FROM orders WHERE o_orderkey % 4 > 0)"""


def _files(spark, d):
    i = read(spark, d, "lineitem").filter("l_orderkey % 3 > 0").selectExpr("l_orderkey AS key", "concat(CASE WHEN l_linenumber % 2 = 0 THEN 'a/b/' ELSE 'a/' END, l_orderkey, '_', l_partkey, '.jpg') AS path")
    return i, read(spark, d, "orders").filter("o_orderkey % 4 > 0").selectExpr("o_orderkey AS key", "concat('x/', o_orderkey, '.xml') AS path", "o_custkey AS ord")


@query("t11_match_images", _FILES + " SELECT key, image, path AS label FROM (SELECT key, first(path ORDER BY len(string_split(path, '/')), path) AS image FROM i GROUP BY key) JOIN b USING (key)")
def t11(spark, d):
    return N.match_images(*_files(spark, d))


@query("t12_unmatched", _FILES + """, r AS (SELECT 'image_without_label' AS kind, key FROM i WHERE key NOT IN (SELECT key FROM b) UNION ALL SELECT 'label_without_image', key FROM b WHERE key NOT IN (SELECT key FROM i)
  UNION ALL SELECT 'repeated_image', key FROM (SELECT key, count(*) - 1 AS n FROM i GROUP BY key), range(999) q(v) WHERE q.v < n)
  SELECT kind, count(*) AS n, array_to_string(list_sort(list_distinct(list(key)))[1:100], ',') AS examples FROM r GROUP BY kind""")
def t12(spark, d):
    return N.unmatched(*_files(spark, d))


@query("s18_check_parts", """WITH p AS (SELECT l_orderkey AS archive, CAST(l_quantity AS BIGINT) AS size, coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, l_partkey % 20 = 0 AS gone FROM lineitem),
  c AS (SELECT archive, off, max(size) AS size, count(DISTINCT size) AS k FROM p WHERE NOT gone GROUP BY ALL), e AS (SELECT *, coalesce(lag(off + size) OVER (PARTITION BY archive ORDER BY off), 0) AS want FROM c)
  SELECT archive, CASE WHEN max(k) > 1 THEN 'size differs' ELSE 'gap' END AS error FROM e GROUP BY archive HAVING max(k) > 1 OR bool_or(off <> want)""")
def s18(spark, d):
    rows = read(spark, d, "lineitem").selectExpr("l_orderkey AS archive", "CAST(l_quantity AS BIGINT) AS size", "coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offset", "l_partkey % 20 = 0 AS gone")
    return N.check_parts(rows.filter("not gone"))


@query("s19_archive_kind", "SELECT l_orderkey AS archive, CASE WHEN count(*) FILTER (l_returnflag = 'R') > 0 AND count(*) FILTER (l_returnflag = 'R') >= count(*) FILTER (l_returnflag = 'A') THEN 'label' WHEN count(*) FILTER (l_returnflag = 'A') > 0 THEN 'image' ELSE 'unknown' END AS kind FROM lineitem GROUP BY 1")
def s19(spark, d):
    return N.archive_kind(read(spark, d, "lineitem").selectExpr("l_orderkey AS archive", "CASE l_returnflag WHEN 'R' THEN 'xml' WHEN 'A' THEN 'jpg' ELSE '' END AS ext"))


_LONG = "(SELECT unnest(['n_car', 'n_bus', 'n_truck']) AS cls, unnest([n_car, n_bus, n_truck]) AS n FROM man)"


@query("e4_class_counts", _M + f", c AS (SELECT cls, CAST(sum(n) AS BIGINT) AS objects, count(*) FILTER (n > 0) AS images FROM {_LONG} GROUP BY cls) SELECT *, round(objects / (SELECT sum(objects) FROM c), 10) AS share FROM c")
def e4(spark, d):
    return D.class_counts(manifest(spark, d))


@query("e5_value_counts_top", _M + """, v AS (SELECT channel AS value, count(*) AS images, count(DISTINCT clip) AS clips FROM man GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY images DESC, value) AS r FROM v)
  SELECT CASE WHEN r <= 3 THEN value ELSE 'others' END AS value, CAST(sum(images) AS BIGINT) AS images, CAST(sum(clips) AS BIGINT) AS clips FROM r GROUP BY 1""")
def e5(spark, d):
    return D.value_counts(manifest(spark, d), "channel", 3)


@query("e6_objects_per_image", _M + f" SELECT cls, round(avg(n), 10) AS mean, round(quantile_cont(n, 0.5), 10) AS median, max(n) AS max, count(*) FILTER (n = 0) AS zero FROM {_LONG} GROUP BY cls")
def e6(spark, d):
    return D.objects_per_image(manifest(spark, d))


@query("e7_object_size", "SELECT p_size % 3 AS cls, round(avg(CAST(a < 1024 AS INT)), 10) AS small, round(avg(CAST(a >= 1024 AND a < 9216 AS INT)), 10) AS medium, round(avg(CAST(a >= 9216 AS INT)), 10) AS large, round(quantile_cont(a, 0.5), 8) AS median_px FROM (SELECT *, p_retailprice * p_size / 5 AS a FROM part) GROUP BY 1")
def e7(spark, d):
    return D.object_size(read(spark, d, "part").selectExpr("p_size % 3 AS cls", "p_retailprice * p_size / 5 AS area_px"))


@query("e8_area_ratio", _M + " SELECT CASE WHEN grouping(weather) = 1 THEN '(all)' ELSE weather END AS value, count(*) AS n, round(avg(ratio), 10) AS mean, round(quantile_cont(ratio, 0.5), 8) AS median, round(quantile_cont(ratio, 0.95), 8) AS p95, max(ratio) AS max FROM man GROUP BY GROUPING SETS ((weather), ())")
def e8(spark, d):
    return D.area_ratio(manifest(spark, d), "weather")


@query("e9_centroid_hist", "SELECT CAST(least(floor(value % 1 * 64), 63) AS INT) AS bx, CAST(least(floor(value / 500 * 36), 35) AS INT) AS by, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM events), 9) AS percent FROM events GROUP BY 1, 2")
def e9(spark, d):
    return D.centroid_hist(read(spark, d, "events").selectExpr("value % 1 AS cx", "value / 500 AS cy"))


@query("e11_frames_per_clip", _M + " SELECT count(*) AS clips, round(avg(n), 10) AS mean, min(n) AS min, max(n) AS max FROM (SELECT clip, count(*) AS n FROM man GROUP BY clip)")
def e11(spark, d):
    return D.frames_per_clip(manifest(spark, d))


@query("e14_class_by_attr", _M + " SELECT day_night AS value, round(sum(n_car) / sum(n_car + n_bus + n_truck), 10) AS car, round(sum(n_bus) / sum(n_car + n_bus + n_truck), 10) AS bus, round(sum(n_truck) / sum(n_car + n_bus + n_truck), 10) AS truck FROM man GROUP BY 1")
def e14(spark, d):
    return D.class_by_attr(manifest(spark, d), "day_night")


@query("e15_group_stats", _M + """ SELECT camera AS value, count(*) AS images, count(DISTINCT clip) AS clips, count(DISTINCT camera) AS cameras, CAST(sum(n) AS BIGINT) AS objects, round(sum(n_car) / sum(n), 10) AS car_share, round(sum(n_bus) / sum(n), 10) AS bus_share, round(sum(n_truck) / sum(n), 10) AS truck_share,
  round(avg(n), 10) AS mean, round(quantile_cont(n, 0.5), 10) AS median, max(n) AS max, round(avg(CAST(n = 0 AS INT)), 10) AS empty, round(count(*) / (SELECT count(*) FROM man), 10) AS share FROM (SELECT *, n_car + n_bus + n_truck AS n FROM man) GROUP BY 1""")
def e15(spark, d):
    return D.group_stats(manifest(spark, d), "camera")


@query("e18_camera_stats", _M + """ SELECT camera, count(*) AS images, count(DISTINCT clip) AS clips, string_agg(DISTINCT weather, ',' ORDER BY weather) AS weathers, string_agg(DISTINCT day_night, ',' ORDER BY day_night) AS day_nights,
  count(*) FILTER (difficulty = 'easy') AS easy, count(*) FILTER (difficulty = 'hard') AS hard FROM man GROUP BY 1""")
def e18(spark, d):
    return D.camera_stats(manifest(spark, d))


@query("e20_cross", _M + " SELECT site AS value, " + ", ".join(f"count(*) FILTER (weather = '{w}') || ' / ' || count(DISTINCT clip) FILTER (weather = '{w}') AS {w}" for w in ("sunny", "rainy", "fog")) + " FROM man GROUP BY 1")
def e20(spark, d):
    return D.cross(manifest(spark, d), "site", "weather", ["sunny", "rainy", "fog"])


@query("e21_difficulty", _M + """ SELECT 'level' AS kind, difficulty AS value, count(*) AS images, count(DISTINCT clip) AS clips, count(DISTINCT camera) AS cameras FROM man GROUP BY 2
  UNION ALL SELECT 'reason', r, count(*), count(DISTINCT clip), count(DISTINCT camera) FROM (SELECT *, unnest(string_split(hard_reasons, '|')) AS r FROM man WHERE hard_reasons <> '') GROUP BY 2
  UNION ALL SELECT * FROM (SELECT 'combination', hard_reasons, count(*), count(DISTINCT clip), count(DISTINCT camera) FROM man GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 12)""")
def e21(spark, d):
    return D.difficulty_stats(manifest(spark, d))


@query("e24_paired_hours", _M + """ SELECT camera, round(a, 10) AS nh, round(b, 10) AS rh, round(b - a, 10) AS diff FROM (SELECT camera, avg(n_car + n_bus + n_truck) FILTER (hour_type = 'NH') AS a, avg(n_car + n_bus + n_truck) FILTER (hour_type = 'RH') AS b FROM man GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL""")
def e24(spark, d):
    return D.paired_hours(manifest(spark, d))


@query("e25_token_table", _M + " SELECT token, count(DISTINCT value) AS \"distinct\", min(value) AS min, max(value) AS max FROM (UNPIVOT (SELECT site, channel, weather FROM man) ON site, channel, weather INTO NAME token VALUE value) GROUP BY 1")
def e25(spark, d):
    return D.token_table(manifest(spark, d), ["site", "channel", "weather"])


@query("e28_diverse_sample")
def e28(spark, d):
    return D.diverse_sample(manifest(spark, d), 10, 7)


@query("x2_class_weights", _M + f", c AS (SELECT cls, sum(n) AS objects FROM {_LONG} GROUP BY cls) SELECT cls, round(pow((SELECT objects FROM c WHERE cls = 'n_car') / objects::DOUBLE, 0.5), 10) AS weight FROM c")
def x2(spark, d):
    return D.class_weights(D.class_counts(manifest(spark, d)))


_F = "f AS (SELECT l_suppkey AS clip, l_orderkey * 10 + l_linenumber AS image_id, l_orderkey AS frame, l_quantity AS score, l_partkey % 40 = 0 AS held FROM lineitem)"


def _clips(spark, d):
    return read(spark, d, "lineitem").selectExpr("l_suppkey AS clip", "l_orderkey * 10 + l_linenumber AS image_id", "l_orderkey AS frame", "l_quantity AS score", "l_partkey % 40 = 0 AS held").dropDuplicates(["clip", "image_id"])


@query("x3_even_pick")
def x3(spark, d):
    return D.even_pick(_clips(spark, d).withColumn("k", F.lit(6)), "k")


@query("x7_leak_risk")
def x7(spark, d):
    return D.leak_risk(_clips(spark, d))


@query("x8_select_priority", _M + """, r AS (SELECT *, image_id % 3 AS risk FROM man ), s AS (SELECT DISTINCT camera, weather, day_night FROM r WHERE risk = 0)
  SELECT image_id, CASE WHEN risk = 1 AND s.camera IS NULL THEN 0 ELSE risk END AS priority FROM r LEFT JOIN s USING (camera, weather, day_night)""")
def x8(spark, d):
    return D.select_priority(manifest(spark, d).withColumn("risk", F.col("image_id") % 3))


@query("x11_split_distribution", _M + """, l AS (UNPIVOT (SELECT split, site, weather FROM man) ON site, weather INTO NAME attribute VALUE value), p AS (SELECT attribute, value, split, count(*) AS n FROM l GROUP BY ALL),
  s AS (SELECT *, n / sum(n) OVER (PARTITION BY attribute, split) AS share FROM p), w AS (SELECT attribute, value, sum(n) AS n FROM p GROUP BY ALL), x AS (SELECT *, n / sum(n) OVER (PARTITION BY attribute) AS whole FROM w)
  SELECT attribute, value, round(any_value(whole), 10) AS whole, round(max(abs(share - whole)), 10) AS max_deviation FROM s JOIN x USING (attribute, value) GROUP BY ALL""")
def x11(spark, d):
    return D.split_distribution(manifest(spark, d), ["site", "weather"])


@query("x14_coverage", _M + " SELECT camera, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM man GROUP BY 1")
def x14(spark, d):
    return D.coverage_table(manifest(spark, d), ["train", "val", "test"])


@query("x15_split_sizes", _M + " SELECT split, count(*) AS images, count(DISTINCT clip) AS clips, count(DISTINCT camera) AS cameras, round(avg(CAST(difficulty = 'hard' AS INT)), 10) AS hard, CAST(sum(n_car + n_bus + n_truck) AS BIGINT) AS objects FROM man GROUP BY 1")
def x15(spark, d):
    return D.split_sizes(manifest(spark, d))


@query("x16_seeded_pick")
def x16(spark, d):
    return D.seeded_pick(manifest(spark, d), 100, 3, "image_id")


@query("s10_brightness", "SELECT l_orderkey AS image, round(avg(l_quantity), 8) AS mean, round(stddev_pop(l_quantity), 8) AS std FROM lineitem GROUP BY 1")
def s10(spark, d):
    return D.image_brightness(read(spark, d, "lineitem").selectExpr("l_orderkey AS image", "l_quantity AS grey"))


@query("e2_integrity", """WITH l AS (SELECT l_orderkey AS image_id, l_linenumber AS n, l_partkey % 5 AS cls, l_quantity / 45 AS v FROM lineitem WHERE l_orderkey % 5 > 0), i AS (SELECT o_orderkey AS image_id FROM orders WHERE o_orderkey % 7 > 0)
  SELECT kind, count(*) AS n, count(DISTINCT image_id) AS images FROM (
  SELECT image_id, CASE WHEN n = 7 THEN 'unparsable' WHEN cls >= 3 THEN 'unknown_class' WHEN n < 3 THEN 'bad_count' WHEN v > 1 THEN 'out_of_range' END AS kind FROM l
  UNION ALL SELECT DISTINCT image_id, 'orphan_label' FROM l WHERE image_id NOT IN (SELECT image_id FROM i) UNION ALL SELECT image_id, 'missing_label' FROM i WHERE image_id NOT IN (SELECT image_id FROM l)) WHERE kind IS NOT NULL GROUP BY 1""")
def e2(spark, d):
    rows = read(spark, d, "lineitem").filter("l_orderkey % 5 > 0")
    value = F.when(F.col("l_linenumber") == 7, "x").otherwise((F.col("l_quantity") / 45).cast("string"))
    tokens = F.concat(F.array((F.col("l_partkey") % 5).cast("string")), F.array_repeat(value, F.when(F.col("l_linenumber") == 7, 6).otherwise(F.col("l_linenumber") * 2)))
    labels = rows.select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("line_no"), tokens.alias("tokens"))
    return D.integrity(labels, read(spark, d, "orders").filter("o_orderkey % 7 > 0").selectExpr("o_orderkey AS image_id"), 3)


@query("e10_vertices", "SELECT l_suppkey AS cls, round(quantile_cont(l_quantity, 0.5), 8) AS median, round(avg(l_quantity), 10) AS mean, max(l_quantity) AS max, round(quantile_cont(l_quantity, 0.995), 8) AS cut FROM lineitem GROUP BY 1")
def e10(spark, d):
    return D.vertices(read(spark, d, "lineitem").selectExpr("l_suppkey AS cls", "l_quantity AS n"))


@query("e13_overlap_summary", _M + """ SELECT CASE WHEN n <= 1 THEN '0-1' WHEN n <= 3 THEN '2-3' WHEN n <= 6 THEN '4-6' ELSE '7+' END AS bin, count(*) AS images, round(avg(ratio), 10) AS mean, round(quantile_cont(ratio, 0.5), 8) AS median, count(*) FILTER (ratio > 0.05) AS over_5_percent
  FROM (SELECT *, n_car + n_bus + n_truck AS n FROM man) GROUP BY 1""")
def e13(spark, d):
    return D.overlap_summary(manifest(spark, d).withColumn("n_objects", F.col("n_car") + F.col("n_bus") + F.col("n_truck")).withColumn("overlap", F.col("ratio")))


@query("e22_road_forms", _M + " SELECT road_form AS value, count(*) AS images, count(DISTINCT clip) AS clips, count(DISTINCT camera) AS cameras, round(count(*) / (SELECT count(*) FROM man), 10) AS share FROM man GROUP BY 1")
def e22(spark, d):
    return D.share_table(manifest(spark, d), "road_form")


@query("e26_spec_numeric", _M + """ SELECT name, min(v) AS min, round(quantile_cont(v, 0.5), 8) AS median, round(avg(v), 6) AS mean, max(v) AS max, round(sum(v), 3) AS sum FROM (UNPIVOT (SELECT CAST(n_car AS DOUBLE) AS n_car, CAST(ratio AS DOUBLE) AS ratio FROM man) ON n_car, ratio INTO NAME name VALUE v) GROUP BY 1""")
def e26(spark, d):
    return D.spec_numeric(manifest(spark, d), ["n_car", "ratio"])


@query("e27_spec_compare", _M + """, c AS (SELECT count(DISTINCT clip) AS k FROM man) SELECT 'weather' AS attribute, round(avg(CAST(weather IN ('sunny', 'fog') AS INT)), 10) AS images, round(count(DISTINCT clip) FILTER (weather IN ('sunny', 'fog')) / (SELECT k FROM c), 10) AS clips FROM man
  UNION ALL SELECT 'day_night', round(avg(CAST(day_night IN ('night') AS INT)), 10), round(count(DISTINCT clip) FILTER (day_night IN ('night')) / (SELECT k FROM c), 10) FROM man""")
def e27(spark, d):
    spec = spark.createDataFrame([("weather", ["sunny", "fog"]), ("day_night", ["night"])], "attribute string, values array<string>")
    return D.spec_compare(manifest(spark, d), spec)


@query("e30_condition_matrix", _M + ' SELECT day_night AS "row", weather AS "col", count(*) AS images, count(DISTINCT clip) AS clips, round(count(*) / (SELECT count(*) FROM man), 10) AS share FROM man GROUP BY 1, 2')
def e30(spark, d):
    return D.condition_matrix(manifest(spark, d), "day_night", "weather")


@query("x13_before_after", _M + " SELECT weather AS value, count(*) AS before, count(*) FILTER (split = 'train') AS after FROM man GROUP BY 1")
def x13(spark, d):
    m = manifest(spark, d)
    return D.before_after(m, m.filter("split = 'train'"), "weather")


_STAT = "count(*) AS images, CAST(sum(n) AS BIGINT) AS objects, round(sum(n_car) / nullif(sum(n), 0), 10) AS car_share, round(sum(n_bus) / nullif(sum(n), 0), 10) AS bus_share, round(sum(n_truck) / nullif(sum(n), 0), 10) AS truck_share, round(avg(n), 10) AS mean, round(quantile_cont(n, 0.5), 10) AS median, max(n) AS max, round(avg(CAST(n = 0 AS INT)), 10) AS empty, round(count(*) / (SELECT count(*) FROM man), 10) AS share"
_N = "(SELECT *, n_car + n_bus + n_truck AS n FROM man)"


def _attr_sql(a: str, first: str) -> str:
    return f"SELECT '{a}' AS attribute, *, CAST(row_number() OVER (ORDER BY {first}, value) AS INT) AS place FROM (SELECT {a} AS value, count(DISTINCT clip) AS clips, count(DISTINCT camera) AS cameras, {_STAT} FROM {_N} GROUP BY 1)"


@query("e17_attr_stats", _M + " " + " UNION ALL ".join([
    _attr_sql("site", "-images"), _attr_sql("day_night", "CASE value WHEN 'day' THEN 1 WHEN 'twilight' THEN 2 WHEN 'night' THEN 3 ELSE 4 END"),
    _attr_sql("weather", "CASE value WHEN 'sunny' THEN 1 WHEN 'rainy' THEN 2 WHEN 'fog' THEN 3 ELSE 6 END"), _attr_sql("time_band", "1"),
]))
def e17(spark, d):
    m, out = manifest(spark, d), None
    for a in ("site", "day_night", "weather", "time_band"):
        one = D.attr_stats(m, a).withColumn("attribute", F.lit(a))
        out = one if out is None else out.unionByName(one)
    return out


@query("e19_clip_stats", _M + f" SELECT clip, {_STAT}, min(camera) AS camera, min(date) AS date, min(time) AS time, min(weather) AS weather, min(difficulty) AS difficulty FROM {_N} GROUP BY 1")
def e19(spark, d):
    return D.clip_stats(manifest(spark, d), ["camera", "date", "time", "weather", "difficulty"])


@query("e1_polygon_table", f"""WITH p AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT vec_id, label, abs({_terms('({x} * {v} - {u} * {y})')}) / 2 AS a FROM p)
  SELECT vec_id AS image_id, 1 AS line_no, label AS cls, 8 AS n_vertices, round(a, 9) AS area_norm, round(a * 1920 * 1080, 3) AS area_px, round(a * 1920 * 1080 * (1280 / 1920::DOUBLE) * (1280 / 1920::DOUBLE), 3) AS area_train_px FROM s""")
def e1(spark, d):
    rows = _points(spark, d).selectExpr("vec_id AS image_id", "1 AS line_no", "label AS cls", "points", "1920D AS width", "1080D AS height")
    return D.polygon_table(rows, 1280).withColumns({c: F.round(c, k) for c, k in (("area_norm", 9), ("area_px", 3), ("area_train_px", 3))})


@query("e16_class_stats", _M + """, l AS (UNPIVOT (SELECT clip, camera, n_car AS car, n_bus AS bus, n_truck AS truck FROM man) ON car, bus, truck INTO NAME cls VALUE n),
  a AS (SELECT cls, count(*) FILTER (n > 0) AS images_with, round(avg(CAST(n > 0 AS INT)), 10) AS images_share, count(DISTINCT clip) FILTER (n > 0) AS clips_with, count(DISTINCT camera) FILTER (n > 0) AS cameras_with, round(avg(n), 10) AS per_image_mean, max(n) AS per_image_max FROM l GROUP BY 1),
  p AS (SELECT CASE WHEN l_partkey % 9 = 0 THEN 'bus' ELSE 'car' END AS cls, l_quantity * 400 AS px, l_linenumber + 2 AS v FROM lineitem),
  s AS (SELECT cls, count(*) AS objects, round(avg(CAST(px / 4 < 1024 AS INT)), 10) AS small, round(avg(CAST(px / 4 >= 1024 AND px / 4 < 9216 AS INT)), 10) AS medium, round(avg(CAST(px / 4 >= 9216 AS INT)), 10) AS large, round(quantile_cont(px / 1000000, 0.5), 8) AS area_median,
    round(quantile_cont(px, 0.5), 6) AS area_median_px, CAST(quantile_cont(v, 0.5) AS DOUBLE) AS vertices_median, CAST(max(v) AS BIGINT) AS vertices_max FROM p GROUP BY 1)
  SELECT a.*, coalesce(objects, 0) AS objects, s.* EXCLUDE (cls, objects), round(coalesce(objects, 0) / (SELECT sum(objects) FROM s)::DOUBLE, 10) AS object_share, round((SELECT objects FROM s WHERE cls = 'car') / greatest(coalesce(objects, 0), 1)::DOUBLE, 8) AS imbalance FROM a LEFT JOIN s ON a.cls = s.cls""")
def e16(spark, d):
    polygons = read(spark, d, "lineitem").selectExpr("CASE WHEN l_partkey % 9 = 0 THEN 'bus' ELSE 'car' END AS cls", "l_quantity * 400 AS area_px", "l_quantity * 100 AS area_train_px", "l_quantity * 400 / 1000000 AS area_norm", "l_linenumber + 2 AS n_vertices")
    return D.class_stats(manifest(spark, d), polygons)


@query("e12_brightness_summary", _M + """, b AS (SELECT *, score / 1000 AS br FROM man) SELECT kind, value, count(*) AS n, round(quantile_cont(br, 0.5), 6) AS brightness FROM (SELECT 'day_night' AS kind, day_night AS value, br FROM b UNION ALL SELECT 'weather', weather, br FROM b) WHERE value <> '' GROUP BY ALL
  UNION ALL SELECT * FROM (SELECT 'clip', clip, count(*), round(avg(br), 6) AS v FROM b GROUP BY clip ORDER BY v, clip LIMIT 5)""")
def e12(spark, d):
    return D.brightness_summary(manifest(spark, d).withColumn("brightness", F.col("score") / 1000))


_FILE = "CASE WHEN o_orderkey % 3 = 0 THEN '1280x720' ELSE '1920x1080' END AS resolution, CASE WHEN o_orderkey % 10 = 0 THEN 'portrait' ELSE 'landscape' END AS orientation, o_custkey AS camera, o_totalprice * 10 AS jpg_bytes, o_totalprice * 60 + o_orderkey AS src_bytes"


@query("e23_quality_stats", f"""WITH f AS (SELECT {_FILE} FROM orders) SELECT CASE WHEN grouping(resolution) = 0 THEN 'resolution' WHEN grouping(orientation) = 0 THEN 'orientation' ELSE 'all' END AS kind, coalesce(resolution, orientation, '') AS value, count(*) AS images,
  count(DISTINCT camera) AS cameras, round(quantile_cont(jpg_bytes / 1024, 0.5), 4) AS median_kb, round(sum(jpg_bytes / 1024) / 1048576, 8) AS total_gb, round(sum(jpg_bytes) / sum(src_bytes), 8) AS ratio FROM f GROUP BY GROUPING SETS ((resolution), (orientation), ())""")
def e23(spark, d):
    return D.quality_stats(read(spark, d, "orders").selectExpr(*[c.strip() for c in _FILE.split(", ")]))


_CLIPS = "o_custkey AS clip, count(*) AS n_frames, CAST(o_custkey % 9 AS BIGINT) AS quota_a, CASE WHEN o_custkey % 3 > 0 THEN CAST(o_custkey % 7 AS BIGINT) END AS quota_b"


def _draw_sql(salt: str, below: str) -> str:
    return f"(('0x' || md5(clip || '|7|{salt}')[1:8])::BIGINT % ({below}))"


_X4 = f"""WITH c AS (SELECT {_CLIPS} FROM orders GROUP BY o_custkey),
  q AS (SELECT *, CASE WHEN quota_b IS NULL THEN least(quota_a, n_frames) WHEN quota_a + quota_b <= n_frames THEN quota_a WHEN quota_a + quota_b - n_frames > abs(quota_a - quota_b) THEN n_frames // 2 WHEN quota_a >= quota_b THEN n_frames - quota_b ELSE quota_a END AS a,
    CASE WHEN quota_b IS NULL THEN NULL WHEN quota_a + quota_b <= n_frames THEN quota_b WHEN quota_a + quota_b - n_frames > abs(quota_a - quota_b) THEN n_frames - n_frames // 2 WHEN quota_a >= quota_b THEN quota_b ELSE n_frames - quota_a END AS b FROM c),
  s AS (SELECT *, (n_frames - a - b) // 2 + 1 AS slack, {_draw_sql('side', '2')} = 0 AS af FROM q),
  t AS (SELECT clip, a, CASE WHEN b IS NULL THEN {_draw_sql('front', 'n_frames - a + 1')} WHEN af THEN {_draw_sql('front', 'slack')} ELSE n_frames - {_draw_sql('back', 'slack')} - a END AS start_a,
    b, CASE WHEN b IS NULL THEN NULL WHEN af THEN n_frames - {_draw_sql('back', 'slack')} - b ELSE {_draw_sql('front', 'slack')} END AS start_b FROM s)"""


@query("x4_place_blocks", _X4 + " SELECT clip, start_a, start_a + a AS end_a, start_b, start_b + b AS end_b FROM t")
def x4(spark, d):
    clips = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_frames"))
    clips = clips.selectExpr("o_custkey AS clip", "n_frames", "CAST(o_custkey % 9 AS BIGINT) AS quota_a", "CASE WHEN o_custkey % 3 > 0 THEN CAST(o_custkey % 7 AS BIGINT) END AS quota_b")
    return D.place_blocks(clips, 7)


_SETS = _X4 + """, o AS (SELECT o_custkey AS clip, o_orderkey AS image_id, o_orderkey // 3 AS frame, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey // 3, o_orderkey) - 1 AS place FROM orders),
  sets AS (SELECT o.clip, image_id, frame, CASE WHEN place >= start_a AND place < start_a + a THEN 'val' WHEN place >= start_b AND place < start_b + b THEN 'test' ELSE 'train' END AS split FROM o LEFT JOIN t ON o.clip = t.clip)"""


def _sets(spark, d):
    return D.assign_split(read(spark, d, "orders").selectExpr("o_custkey AS clip", "o_orderkey AS image_id", "o_orderkey div 3 AS frame"), x4(spark, d))


@query("x10_assign_split", _SETS + " SELECT clip, image_id, frame, split FROM sets")
def x10(spark, d):
    return _sets(spark, d)


@query("x10_clip_ranges", _SETS + " SELECT clip, split, count(*) AS frames, min(frame) AS first_frame, max(frame) AS last_frame FROM sets GROUP BY ALL")
def x10r(spark, d):
    return D.clip_ranges(_sets(spark, d))


_REDUCE = _M + """, p0 AS (SELECT camera, concat(camera, '_', image_id % 4) AS clip, image_id, frame, difficulty, image_id % 7 % 3 AS priority, score FROM man), qt AS (SELECT camera, count(*) // 2 AS quota FROM p0 GROUP BY 1),
  p AS (SELECT *, CASE WHEN difficulty = 'hard' THEN [0, 1, 4][priority + 1] ELSE [2, 3, 5][priority + 1] END AS tier FROM p0),
  sz AS (SELECT camera, tier, clip, count(*) AS size FROM p GROUP BY ALL), tt AS (SELECT camera, tier, sum(size) AS total FROM sz GROUP BY ALL),
  kk AS (SELECT camera, tier, total, greatest(least(quota - before, total), 0) AS k FROM (SELECT *, coalesce(sum(total) OVER (PARTITION BY camera ORDER BY tier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM tt) JOIN qt USING (camera)),
  sh AS (SELECT camera, tier, clip, CAST(base + CASE WHEN row_number() OVER (PARTITION BY camera, tier ORDER BY k * size - base * total DESC, clip) <= k - sum(base) OVER (PARTITION BY camera, tier) THEN 1 ELSE 0 END AS BIGINT) AS k
    FROM (SELECT sz.*, total, k, CAST(k * size AS BIGINT) // CAST(total AS BIGINT) AS base FROM sz JOIN kk USING (camera, tier))),
  po AS (SELECT p.*, k, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY camera, tier, clip) AS n FROM p JOIN sh USING (camera, tier, clip) WHERE k > 0 WINDOW w AS (PARTITION BY camera, tier, clip ORDER BY frame, image_id)),
  pt AS (SELECT *, least(pos * k // n, k - 1) AS part FROM po),
  best AS (SELECT image_id FROM (SELECT *, row_number() OVER (PARTITION BY camera, tier, clip, part ORDER BY score DESC, round(abs(pos + 0.5 - (part + 0.5) * n / k), 9), pos) AS r FROM pt) WHERE r = 1),
  sel AS (SELECT image_id, camera, difficulty, CASE WHEN image_id NOT IN (SELECT image_id FROM best) THEN 'dropped_' || difficulty WHEN difficulty = 'hard' THEN 'hard' ELSE 'easy_fill' END AS selection FROM p)"""


def _reduced(spark, d):
    pool = manifest(spark, d).selectExpr("camera", "concat(camera, '_', image_id % 4) AS clip", "image_id", "frame", "difficulty", "image_id % 7 % 3 AS priority", "score")
    quotas = pool.groupBy("camera").agg(F.floor(F.count("*") / 2).alias("quota"))
    return D.reduce_train(pool, quotas), quotas


@query("x9_reduce_train", _REDUCE + " SELECT * FROM sel")
def x9(spark, d):
    return _reduced(spark, d)[0]


@query("x9_report", _REDUCE + """ SELECT camera, count(*) AS pool, count(*) FILTER (difficulty = 'hard') AS pool_hard, count(*) FILTER (selection = 'hard') AS selected_hard, count(*) FILTER (selection = 'easy_fill') AS selected_easy,
  any_value(quota) AS quota, any_value(quota) - count(*) FILTER (selection IN ('hard', 'easy_fill')) AS shortfall FROM sel JOIN qt USING (camera) GROUP BY 1""")
def x9r(spark, d):
    return D.reduction_report(*_reduced(spark, d))


_PX = 24  # pixels a side of the raster


@query("e3_coverage", f"""WITH p AS (SELECT vec_id AS id, vec_id // 4 AS image_id, list_transform(range(8), lambda k: 0.5::DOUBLE + 1.5::DOUBLE * embedding[2 * k + 1]::DOUBLE) AS xs, list_transform(range(8), lambda k: 0.5::DOUBLE + 1.5::DOUBLE * embedding[2 * k + 2]::DOUBLE) AS ys FROM embeddings),
  e AS (SELECT id, image_id, xs[k] * {_PX} AS ax, ys[k] * {_PX} AS ay, xs[k % 8 + 1] * {_PX} AS cx, ys[k % 8 + 1] * {_PX} AS cy FROM p, range(1, 9) t(k)),
  g AS (SELECT image_id, id, gx, gy, count(*) AS n FROM e, range({_PX}) x(gx), range({_PX}) y(gy) WHERE (ay <= gy + 0.5::DOUBLE) <> (cy <= gy + 0.5::DOUBLE) AND ax + (gy + 0.5::DOUBLE - ay) * (cx - ax) / (cy - ay) - 0.5::DOUBLE <= gx GROUP BY ALL HAVING n % 2 = 1),
  u AS (SELECT image_id, gx, gy, count(*) AS k FROM g GROUP BY ALL), s AS (SELECT image_id, count(*) AS un, CAST(sum(k) AS BIGINT) AS sm FROM u GROUP BY 1)
  SELECT image_id, round(coalesce(un, 0) / {_PX * _PX}::DOUBLE, 9) AS vehicle_area_ratio, round(coalesce(sm, 0) / {_PX * _PX}::DOUBLE, 9) AS vehicle_area_sum, round(CASE WHEN sm > 0 THEN 1 - un / sm::DOUBLE ELSE 0 END, 9) AS overlap_ratio FROM (SELECT DISTINCT image_id FROM p) LEFT JOIN s USING (image_id)""")
def e3(spark, d):
    moved = F.transform("points", lambda p: F.struct((p["x"] * 1.5 + 0.5).alias("x"), (p["y"] * 1.5 + 0.5).alias("y")))
    rows = _points(spark, d).select(F.expr("vec_id div 4").alias("image_id"), moved.alias("points"), F.lit(_PX * 4).alias("width"), F.lit(_PX * 4).alias("height"))
    out = C.coverage(rows.select("image_id", "width", "height").distinct(), rows)
    return out.select("image_id", *(F.round(c, 9).alias(c) for c in out.columns[1:]))


_IMAGES = "concat(clip, '_', lpad(CAST(image_id % 1000 AS {text}), 3, '0')) AS stem, 'r' AS region, 'a.zip' AS image_archive, 'b.zip' AS label_archive, 'm' AS zip_member, 'x' AS xml_member, CASE image_id % 4 WHEN 0 THEN 1920 WHEN 1 THEN 1280 WHEN 2 THEN 720 ELSE 1080 END AS width, CASE image_id % 4 WHEN 0 THEN 1080 WHEN 1 THEN 720 WHEN 2 THEN 1280 ELSE 1080 END AS height, 1920 AS xml_width, 1080 AS xml_height, 'RGB' AS src_mode, image_id * 3 AS src_bytes, image_id AS jpg_bytes, n_car AS gt_car, n_bus AS gt_bus, n_truck AS gt_truck, image_id % 2 AS n_dropped_polygons"


@query("t14_manifest", _M + f""", i AS (SELECT {_IMAGES.format(text='VARCHAR')}, man.* FROM man)
  SELECT stem AS image_id, stem || '.jpg' AS file_name, clip, width, height, width <> 1920 OR height <> 1080 AS size_scaled, concat(width, 'x', height) AS resolution, CASE WHEN width > height THEN 'landscape' WHEN height > width THEN 'portrait' ELSE 'square' END AS orientation,
    CAST(src_bytes AS BIGINT) AS src_bytes, CAST(n_car + n_bus + n_truck AS INT) AS gt_total, meta_parsed, site, channel, camera, day_night, time_band, road_form, hard_reasons, difficulty, CAST(image_id % 1000 AS INT) AS frame FROM i""")
def t14(spark, d):
    """Assembled, written, and read back checked."""
    rows = parsed(spark, d).select("clip", "image_id", "n_car", "n_bus", "n_truck")
    path = work_folder(spark, "assembled")
    N.build_manifest(rows.selectExpr("clip", *_split(_IMAGES.format(text="STRING")))).write.parquet(path)
    columns = ("image_id", "file_name", "clip", "width", "height", "size_scaled", "resolution", "orientation", "src_bytes", "gt_total", "meta_parsed", "site", "channel", "camera", "day_night", "time_band", "road_form", "hard_reasons", "difficulty", "frame")
    return N.read_kept_manifest(spark, path).select(*columns)


def _split(columns: str) -> list[str]:
    """The expressions of a list whose commas may stand in brackets."""
    out, depth = [""], 0
    for c in columns:
        depth += (c == "(") - (c == ")")
        out = [*out, ""] if c == "," and not depth else [*out[:-1], out[-1] + c]
    return [c.strip() for c in out]


_NOTED = " UNION ALL ".join(f"SELECT '{a}', '{v}', count(*) FILTER ({a} = '{v}') / count(*) FROM f" for a, vs in D.NOTED.items() for v in vs)
_SHARES = " UNION ALL ".join(f"SELECT 'class_share', '{c}', sum(n_{c}) / sum(n) FROM f" for c in D.CLASSES)


@query("e29_findings", _M + f""", f AS (SELECT *, n_car + n_bus + n_truck AS n, score / 1000 AS brightness, ratio AS overlap FROM man), c AS (SELECT camera, count(DISTINCT clip) AS clips, count(*) FILTER (difficulty <> 'easy') AS hard FROM f GROUP BY 1),
  b AS (SELECT site, sum(n_bus) AS k FROM f GROUP BY 1 HAVING sum(n_bus) > 0), t AS (SELECT * FROM b ORDER BY k DESC, site LIMIT 3), h AS (SELECT camera, avg(n) FILTER (hour_type = 'NH') AS nh, avg(n) FILTER (hour_type = 'RH') AS rh FROM f GROUP BY 1 HAVING nh IS NOT NULL AND rh IS NOT NULL),
  p AS (SELECT CASE WHEN l_partkey % 9 = 0 THEN 'bus' ELSE 'car' END AS cls, l_quantity * 100 AS px FROM lineitem),
  r(finding, name, value) AS ({_SHARES} UNION ALL {_NOTED} UNION ALL SELECT 'bus_images', '', count(*) FILTER (n_bus > 0) / count(*) FROM f UNION ALL SELECT 'empty_images', '', count(*) FILTER (n = 0) FROM f UNION ALL SELECT 'overlap', '', avg(overlap) FILTER (n >= 2) FROM f
    UNION ALL SELECT 'easy', 'images', count(*) FILTER (difficulty = 'easy') FROM f UNION ALL SELECT 'easy', 'share', count(*) FILTER (difficulty = 'easy') / count(*) FROM f UNION ALL SELECT 'easy', 'hard_images', count(*) FILTER (difficulty <> 'easy') FROM f
    UNION ALL SELECT 'easy', 'cameras_easy_only', count(*) FILTER (hard = 0) FROM c UNION ALL SELECT 'few_clips', camera, clips FROM c WHERE clips <= 2 UNION ALL SELECT 'night_clips', site, count(DISTINCT clip) FROM f WHERE day_night = 'night' GROUP BY site
    UNION ALL SELECT 'bus_sites', site, k FROM t UNION ALL SELECT 'bus_sites', '(share)', (SELECT sum(k) FROM t) / (SELECT sum(k) FROM b) UNION ALL SELECT 'paired_hours', 'rush_clips', count(DISTINCT clip) FROM f WHERE hour_type = 'RH'
    UNION ALL SELECT 'paired_hours', 'cameras_with_both', count(*) FROM h UNION ALL SELECT 'paired_hours', 'cameras_more_in_rush', count(*) FILTER (rh > nh) FROM h UNION ALL SELECT 'brightness', day_night, quantile_cont(brightness, 0.5) FROM f WHERE day_night <> '' GROUP BY day_night
    UNION ALL SELECT 'small_objects', CASE WHEN grouping(cls) = 1 THEN '(all)' ELSE cls END, avg(CAST(px < 1024 AS INT)) FROM p GROUP BY GROUPING SETS ((cls), ()))
  SELECT finding, name, round(CAST(value AS DOUBLE), 8) AS value FROM r""")
def e29(spark, d):
    rows = manifest(spark, d).withColumns({"brightness": F.col("score") / 1000, "overlap": F.col("ratio")})
    polygons = read(spark, d, "lineitem").selectExpr("CASE WHEN l_partkey % 9 = 0 THEN 'bus' ELSE 'car' END AS cls", "l_quantity * 100 AS area_train_px")
    return D.findings(rows, polygons).withColumn("value", F.round("value", 8))
