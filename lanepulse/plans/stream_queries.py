"""Batch runs of the streaming operators over the events, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.kept import work_folder
from ..streaming import samples as W
from .models import level_sql, samples, seconds, with_sql

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


_MEANS = ", ".join(f"round(avg({c}), 10) AS {c}" for c in W.MEANS)
_SAMPLES = with_sql("samples")


@query("w1_sample_windows", _SAMPLES + f" SELECT floor(t / 3600) * 3600 AS t, camera_id, direction_index, {_MEANS}, count(*) AS n_frames FROM samples GROUP BY 1, 2, 3")
def w1(spark, d):
    rows = W.sample_windows(samples(spark, d), 3600)
    return rows.select(F.expr(seconds("ts")).alias("t"), "camera_id", "direction_index", *(F.round(c, 10).alias(c) for c in W.MEANS), "n_frames")


@query("w2_per_frame", _SAMPLES + " SELECT camera_id, direction_index, occupancy, CAST(1 AS BIGINT) AS n_frames FROM samples")
def w2(spark, d):
    return W.per_frame(samples(spark, d)).select("camera_id", "direction_index", "occupancy", "n_frames")


_CAMERA = "CASE WHEN event_id % 97 = 5 THEN NULL ELSE user_id END"


def _frames(spark, d):
    """Frames of cameras, some of an unknown one."""
    rows = samples(spark, d).withColumn("user_id", F.col("camera_id"))
    return rows.selectExpr(f"{_CAMERA} AS camera_id", "timestamp_micros(CAST(t * 1000000 AS BIGINT)) AS ts", "t", "event_id AS seq", "CASE WHEN camera_id % 3 = 0 THEN 300D ELSE 10D END AS source_fps")


_FRAMES = _SAMPLES.replace("user_id AS camera_id", f"{_CAMERA} AS camera_id, user_id % 3 = 0 AS slow") + ", f AS (SELECT camera_id, t, event_id AS seq, CASE WHEN slow THEN 8 ELSE 5 END AS every FROM samples)"


def _run(spark, rows, part, transform, append="append"):
    """What ``transform`` makes of a stream of ``rows``: files by the column ``part`` in order, a file a micro-batch, read
    to their end and written to a table that is returned."""
    path = work_folder(spark, "stream")
    schema = rows.drop(part).schema
    for k in range(rows.agg(F.max(part)).first()[0] + 1):
        rows.filter(F.col(part) == k).drop(part).coalesce(1).write.mode("append").parquet(f"{path}/in")
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = transform(session.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"))
    done = out.writeStream.format("parquet").option("checkpointLocation", f"{path}/check").outputMode(append).trigger(availableNow=True)
    done.start(f"{path}/out").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


#: Days since the first, in blocks of eight: the order in which frames arrive.
_BLOCK = "CAST(floor((unix_seconds(ts) - 1704067200) / (8 * 86400)) AS INT)"

_W4 = _FRAMES + " SELECT camera_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY t, seq) AS n FROM f) WHERE n % every = 0"
_W4_IDLE = _FRAMES + """, g AS (SELECT *, coalesce(CAST(t - lag(t) OVER (PARTITION BY camera_id ORDER BY t, seq) > 129600 AS INT), 0) AS fresh FROM f), h AS (SELECT *, sum(fresh) OVER (PARTITION BY camera_id ORDER BY t, seq) AS run FROM g)
  SELECT camera_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY camera_id, run ORDER BY t, seq) AS n FROM h) WHERE n % every = 0"""


@query("w4_stride_sample", _W4)
def w4(spark, d):
    return W.stride_sample(_frames(spark, d), 2.0).select("camera_id", "seq")


@query("w4_stride_stream", _W4_IDLE)
def w4s(spark, d):
    rows = _frames(spark, d).withColumn("part", F.expr(_BLOCK))
    return _run(spark, rows, "part", lambda s: W.stride_sample(s.withWatermark("ts", "1 hour"), 2.0, 129_600.0)).select("camera_id", "seq")


_W5 = _FRAMES.replace("WITH", "WITH RECURSIVE", 1) + """, k AS (SELECT camera_id, min({t: t, seq: seq}) AS r FROM f GROUP BY 1
  UNION ALL SELECT k.camera_id, min({t: f.t, seq: f.seq}) FROM k JOIN f ON f.camera_id IS NOT DISTINCT FROM k.camera_id AND f.t - k.r.t >= 86400 GROUP BY 1) SELECT camera_id, r.t AS t, r.seq AS seq FROM k"""


@query("w5_rate_limit", _W5)
def w5(spark, d):
    return W.rate_limit(_frames(spark, d), 86_400.0)


@query("w5_rate_stream", _W5)
def w5s(spark, d):
    return _run(spark, _frames(spark, d).withColumn("part", F.expr(_BLOCK)), "part", lambda s: W.rate_limit(s.withWatermark("ts", "1 hour"), 86_400.0))


_EVENTS = _SAMPLES + """, e AS (SELECT camera_id, direction_index, event_id AS seq, t, occupancy, CAST(floor((t - 1704067200) / 432000) AS INT) AS home FROM samples),
  arrived AS (SELECT *, least(CASE WHEN seq % 50 = 7 THEN home + 2 ELSE home END, 5) AS part FROM e UNION ALL SELECT *, home FROM e WHERE seq % 20 = 3 UNION ALL SELECT *, least(home + 1, 5) FROM e WHERE seq % 20 = 3),
  seen AS (SELECT part, max(floor(t * 1000)) AS top FROM arrived GROUP BY 1), marks AS (SELECT part, coalesce(max(top) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - 172800000, 0) AS mark FROM seen)"""


@query("w12_stream_windows", _EVENTS + """, let AS (SELECT DISTINCT camera_id, direction_index, seq, t, occupancy FROM arrived JOIN marks USING (part) WHERE t * 1000 > mark)
  SELECT floor(t / 3600) * 3600 AS t, camera_id, direction_index, round(avg(occupancy), 10) AS occupancy, count(*) AS n_frames FROM let GROUP BY 1, 2, 3 HAVING (floor(t / 3600) * 3600 + 3600) * 1000 <= (SELECT max(top) - 172800000 FROM seen)""")
def w12(spark, d):
    """Windows of an hour over a stream in six files, five days each: every fiftieth frame comes two files late, every
    twentieth comes again in its own and in the next file. The watermark lets two days pass; a micro-batch
    drops what is older than the watermark of the batch before it."""
    rows = samples(spark, d).select("camera_id", "direction_index", F.col("event_id").alias("seq"), F.expr("timestamp_micros(CAST(t * 1000000 AS BIGINT))").alias("ts"), *W.MEANS)
    rows = rows.withColumn("home", F.floor((F.unix_seconds("ts") - 1704067200) / 432_000).cast("int"))
    first = rows.withColumn("part", F.least(F.when(F.col("seq") % 50 == 7, F.col("home") + 2).otherwise(F.col("home")), F.lit(5)))
    again = rows.filter("seq % 20 = 3")
    arrived = first.unionByName(again.withColumn("part", F.col("home"))).unionByName(again.withColumn("part", F.least(F.col("home") + 1, F.lit(5)))).drop("home")
    out = _run(spark, arrived, "part", lambda s: W.sample_windows(s, 3600, "2 days"))
    return out.select(F.unix_seconds("ts").cast("double").alias("t"), "camera_id", "direction_index", F.round("occupancy", 10).alias("occupancy"), "n_frames")


@query("w9_episode_stream", _SAMPLES + """, o AS (SELECT camera_id, direction_index, t, occupancy, event_id, occupancy >= 0.15 AS high, lag(t) OVER w AS pt, lag(occupancy >= 0.15) OVER w AS ph, lead(t) OVER w AS nt FROM samples WINDOW w AS (PARTITION BY camera_id, direction_index ORDER BY t, occupancy)),
  i AS (SELECT *, sum(CASE WHEN high AND ph AND t - pt <= 172800 THEN 0 ELSE 1 END) OVER (PARTITION BY camera_id, direction_index ORDER BY t, occupancy) AS isle FROM o),
  g AS (SELECT camera_id, direction_index, min(t) AS start_t, max(t) AS end_t, max(occupancy) AS peak, avg(occupancy) AS mean, count(*) AS samples, arg_max_null(nt, t) AS nt FROM i WHERE high GROUP BY camera_id, direction_index, isle)
  SELECT camera_id, direction_index, round(start_t, 3) AS start_t, round(end_t, 3) AS end_t, peak, round(mean, 10) AS mean, samples FROM g WHERE samples >= 2 AND end_t - start_t >= 3600
    AND (nt IS NOT NULL OR floor((end_t + 172800) * 1000) < floor((SELECT max(t) FROM samples) * 1000) - 3600000)""")
def w9(spark, d):
    """Episodes of a stream in four files; one that is open at the end counts once the watermark is past its gap."""
    rows = samples(spark, d).select("camera_id", "direction_index", F.expr("timestamp_micros(CAST(t * 1000000 AS BIGINT))").alias("ts"), "occupancy").withColumn("part", F.expr(_BLOCK))
    out = _run(spark, rows, "part", lambda s: W.episode_stream(s.withWatermark("ts", "1 hour"), 0.15, 172_800.0, 3600.0))
    t = lambda c: F.round(F.unix_micros(c) / 1_000_000, 3).alias(c.replace("_ts", "_t"))
    return out.select("camera_id", "direction_index", t("start_ts"), t("end_ts"), "peak", F.round("mean", 10).alias("mean"), "samples")


@query("w6_inference_rate", _FRAMES + " SELECT camera_id, seq, round(coalesce(CASE WHEN g > 0 THEN 1 / g END, 0), 10) AS fps FROM (SELECT *, t - lag(t) OVER (PARTITION BY camera_id ORDER BY t, seq) AS g FROM f)")
def w6(spark, d):
    return W.inference_rate(_frames(spark, d)).select("camera_id", "seq", F.round("fps", 10).alias("fps"))


_VIDEO = _SAMPLES + ", f AS (SELECT *, event_id // 4 AS idx FROM samples)"


def _video(spark, d):
    return samples(spark, d).withColumn("idx", F.floor(F.col("event_id") / 4))


@query("w10_video_samples", _VIDEO + """, n AS (SELECT camera_id, CAST(floor(idx / 30) AS BIGINT) AS second, count(DISTINCT idx) AS n_frames FROM f WHERE idx % 2 = 0 GROUP BY 1, 2),
  s AS (SELECT camera_id, CAST(floor(idx / 30) AS BIGINT) AS second, direction_index, sum(occupancy) AS o, sum(n_car) AS c FROM f WHERE idx % 2 = 0 GROUP BY 1, 2, 3)
  SELECT camera_id, second, direction_index, round(o / n_frames, 10) AS occupancy, round(c / n_frames, 10) AS n_car, n_frames FROM s JOIN n USING (camera_id, second)""")
def w10(spark, d):
    return W.video_samples(_video(spark, d), 30.0, 2)


@query("w11_video_summary", _VIDEO + """, w AS (SELECT camera_id, floor(max(idx) / 30.0::DOUBLE * 10 + 0.5) / 10 AS duration_s, count(DISTINCT idx) AS processed FROM f GROUP BY 1)
  SELECT camera_id, direction_index, round(avg(occupancy), 10) AS mean, max(occupancy) AS max, round(quantile_cont(occupancy, 0.9), 9) AS p90, any_value(duration_s) AS duration_s, any_value(processed) AS processed FROM f JOIN w USING (camera_id) GROUP BY 1, 2""")
def w11(spark, d):
    return W.video_summary(_video(spark, d), 30.0)


@query("s13_purge_unmeasured", _SAMPLES + " SELECT event_id, direction_index FROM samples WHERE NOT (direction_index > 0 AND event_id % 4 = 0)")
def s13(spark, d):
    from ..sources.files import purge_unmeasured

    rows = samples(spark, d).withColumn("road_px", F.when(F.col("event_id") % 4 == 0, 0.0).otherwise(F.col("road_px")))
    return purge_unmeasured(rows).select("event_id", "direction_index")


@query("s14_history_table", with_sql("samples", "directions") + """ SELECT strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS time, s.camera_id, coalesce(d.name, '') AS direction, round(occupancy + 1e-9, 4) AS occupancy, n_car, n_bus, n_truck, """ + level_sql("occupancy + 1e-9") + """ AS level
  FROM samples s LEFT JOIN directions d ON d.camera_id = s.camera_id AND d.index = s.direction_index""")
def s14(spark, d):
    from ..sources.files import history_table
    from .models import directions

    names = directions(spark, d).select("camera_id", F.col("index").alias("direction_index"), F.col("name").alias("direction_name"))
    # the zoneless times are UTC: the export reads them in the session's zone
    rows = samples(spark, d).withColumn("occupancy", F.col("occupancy") + 1e-9).withColumn("ts", F.expr("timestamp_micros(CAST(t * 1000000 AS BIGINT))"))
    return history_table(rows, names)


@query("s15_summary_table", with_sql("samples", "cameras", "directions") + """, m AS (SELECT camera_id, direction_index, round(avg(occupancy), 10) AS o, round(avg(n_car + n_bus + n_truck), 10) AS nv FROM samples GROUP BY 1, 2)
  SELECT route AS group_name, id AS camera_id, '전체' AS direction_name, coalesce(o, 0) AS occupancy, coalesce(nv, 0) AS nv FROM cameras LEFT JOIN m ON camera_id = id AND direction_index = 0
  UNION ALL SELECT route, id, d.name, o, nv FROM cameras JOIN directions d ON d.camera_id = id JOIN m ON m.camera_id = id AND m.direction_index = d.index""")
def s15(spark, d):
    from ..operators.metrics import vehicles
    from ..sources.files import summary_table
    from .models import cameras, directions

    m = samples(spark, d).groupBy("camera_id", "direction_index").agg(F.round(F.avg("occupancy"), 10).alias("occupancy"), F.round(F.avg(vehicles()), 10).alias("nv"))
    whole = cameras(spark, d).select(F.col("route").alias("group_name"), F.col("id").alias("camera_id")).join(m.filter("direction_index = 0").drop("direction_index"), "camera_id", "left")
    per = directions(spark, d).select("camera_id", F.col("index").alias("direction_index"), F.col("name").alias("direction_name")).join(m, ["camera_id", "direction_index"])
    return summary_table(whole, per.drop("direction_index"))
