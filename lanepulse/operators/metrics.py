"""Sample analytics: histories, summaries, timelines, episodes, heatmaps, rankings.

Inputs are sample tables with ``camera_id``, ``direction_index`` (0 is the whole camera),
``t`` (seconds), ``source``, ``occupancy`` and vehicle counts. "Now" is always a parameter or
the latest sample, so that results are repeatable.
"""

from __future__ import annotations

import math
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.kept import ranked
from ..functions.levels import LEVELS, level

DAY = 86400
KST = 9 * 3600
UNNAMED = "(미지정)"
WHOLE = "전체"


def vehicles() -> Column:
    return F.col("n_car") + F.col("n_bus") + F.col("n_truck")



def latest_time(samples: DataFrame) -> float | None:
    return samples.agg(F.max("t")).first()[0]


def since(samples: DataFrame, minutes: float, source: str = "live", as_of: float | None = None) -> DataFrame:
    """Samples of a source in the window that ends at ``as_of`` (the latest sample if none)."""
    rows = samples.filter(F.col("source") == source)
    as_of = latest_time(samples) if as_of is None else as_of
    return from_time(rows, (as_of or 0) - minutes * 60)


def from_time(samples: DataFrame, start: float) -> DataFrame:
    """Samples from a time on. Where they have the column ``ts`` that ``t`` is derived from, the filter names it too, for
    files to be skipped by its statistics."""
    rows = samples.filter(F.col("t") >= start)
    kind = dict(samples.dtypes).get("ts")
    if kind not in ("timestamp", "timestamp_ntz"):
        return rows
    at = datetime.fromtimestamp(math.floor(start), UTC)  # a whole second before: the exact bound is that of t
    text = at.strftime("%Y-%m-%d %H:%M:%S") + ("+00:00" if kind == "timestamp" else "")
    return rows.filter(F.col("ts") >= F.lit(text).cast(kind))


def scan(samples: DataFrame, source: str | None = None, start: float | None = None, camera: int | None = None, direction: int | None = None) -> DataFrame:
    for name, op, value in (("source", "eq", source), ("camera_id", "eq", camera), ("direction_index", "eq", direction)):
        if value is not None:
            samples = samples.filter(F.col(name) == value)
    return samples if start is None else from_time(samples, start)


def bucket(time: str, width: float) -> Column:
    return (F.floor(F.col(time) / width) * width).cast("double")


def history(samples: DataFrame, width: float, time: str = "t") -> DataFrame:
    """Per camera, direction and time bucket: means, maximum, frame count and level."""
    return (
        samples.groupBy("camera_id", "direction_index", bucket(time, width).alias("bucket"))
        .agg(
            F.round(F.avg("occupancy"), 10).alias("occupancy"),
            F.max("occupancy").alias("max_occupancy"),
            F.round(F.avg(vehicles()), 10).alias("nv"),
            *(F.round(F.avg(c), 10).alias(c) for c in ("n_car", "n_bus", "n_truck")),
            F.sum("n_frames").cast("long").alias("n_frames"),
        )
        .withColumn("level", level(F.col("occupancy")))
    )


def summary_by_direction(samples: DataFrame, cameras: DataFrame, directions: DataFrame) -> DataFrame:
    """Window summary per camera and direction with resolved names; unknown cameras drop out."""
    stats = samples.groupBy("camera_id", "direction_index").agg(
        F.round(F.avg("occupancy"), 10).alias("avg_occupancy"),
        F.max("occupancy").alias("max_occupancy"),
        F.round(F.avg(vehicles()), 10).alias("nv"),
        F.count("*").alias("samples"),
    )
    known = stats.join(cameras.select(F.col("id").alias("camera_id"), F.col("name").alias("camera_name")), "camera_id")
    named = known.join(directions.select("camera_id", F.col("index").alias("direction_index"), F.col("name").alias("dname")), ["camera_id", "direction_index"], "left")
    name = F.when(F.col("direction_index") == 0, WHOLE).otherwise(F.coalesce("dname", F.concat(F.lit("방향 "), F.col("direction_index").cast("string"))))
    return named.select("camera_id", "camera_name", "direction_index", name.alias("direction_name"), "avg_occupancy", "max_occupancy", "nv", "samples", level(F.col("avg_occupancy")).alias("level"))


def camera_means(samples: DataFrame) -> DataFrame:
    return samples.filter("direction_index = 0").groupBy("camera_id").agg(F.avg("occupancy").alias("occ"), F.max("occupancy").alias("peak"), F.avg(vehicles()).alias("nv"), F.count("*").alias("samples"))


def group_key(by: str) -> Column:
    return F.coalesce(F.nullif(F.col(by), F.lit("")), F.lit(UNNAMED))


def roll_up(samples: DataFrame, cameras: DataFrame, by: str) -> DataFrame:
    """Groups of cameras: mean and maximum of the camera means, vehicles summed."""
    rows = camera_means(samples).join(cameras, F.col("camera_id") == F.col("id"))
    out = rows.groupBy(group_key(by).alias("group_name")).agg(
        F.round(F.avg("occ"), 10).alias("occupancy"), F.round(F.max("occ"), 10).alias("max_occupancy"), F.count("*").alias("n_cameras"), F.round(F.sum("nv"), 10).alias("nv")
    )
    return out.withColumn("level", level(F.col("occupancy")))


def sort_groups(groups: DataFrame, key: str = "occupancy", descending: bool = True) -> DataFrame:
    """Groups ordered by a key, nulls as -1, with their place."""
    k = F.coalesce(F.col(key), F.lit(-1.0))
    w = W.orderBy(k.desc() if descending else k.asc(), "group_name")  # one row per group
    return groups.withColumn("place", F.row_number().over(w))


def timeline(samples: DataFrame, width: float, first: float, last: float, direction: int = 0) -> DataFrame:
    """A dense grid of buckets and cameras that have samples, with means or null."""
    rows = samples.filter(F.col("direction_index") == direction)
    got = rows.groupBy("camera_id", bucket("t", width).alias("bucket")).agg(F.round(F.avg("occupancy") + 1e-9, 4).alias("occupancy"), F.round(F.avg(vehicles()) + 1e-9, 2).alias("nv"))
    lo, hi = int(first // width), int(last // width)
    grid = rows.select("camera_id").distinct().select("camera_id", F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("i"))
    grid = grid.select("camera_id", (F.col("i") * F.lit(float(width))).alias("bucket"))
    return grid.join(got, ["camera_id", "bucket"], "left")


def episodes(samples: DataFrame, min_level: int = 2, gap: float = 20.0, min_duration: float = 30.0, as_of: float | None = None, thresholds=(0.08, 0.15, 0.25)) -> DataFrame:
    """Congestion episodes: runs of samples at or above a level, ended by a lower sample or a gap.

    Gaps and islands over one window per camera and direction; runs of two samples at least
    and of the least duration remain."""
    as_of = latest_time(samples) if as_of is None else as_of
    w = W.partitionBy("camera_id", "direction_index").orderBy("t", "event_id")
    high = F.col("occupancy") >= thresholds[min_level - 1]
    rows = samples.withColumn("high", high).withColumn("before", F.lag("high").over(w)).withColumn("previous", F.lag("t").over(w))
    opens = F.col("high") & (F.coalesce(~F.col("before"), F.lit(True)) | (F.col("t") - F.col("previous") > gap))
    rows = rows.withColumn("island", F.sum(opens.cast("int")).over(w)).filter("high")
    out = rows.groupBy("camera_id", "direction_index", "island").agg(
        F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.max("occupancy").alias("peak"), F.round(F.avg("occupancy"), 10).alias("mean"), F.round(F.avg(vehicles()), 10).alias("nv"), F.count("*").alias("samples")
    )
    out = out.withColumn("duration_s", F.floor(F.col("end_t") - F.col("start_t"))).filter(f"samples >= 2 AND end_t - start_t >= {min_duration}")
    return out.drop("island").withColumn("level", level(F.col("peak"))).withColumn("ongoing", F.lit(as_of) - F.col("end_t") < gap)


def newest(rows: DataFrame, k: int = 200) -> DataFrame:
    """The newest ``k`` episodes, with the count before the cut."""
    n = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(F.desc("start_t"), "camera_id", "direction_index").limit(k).crossJoin(F.broadcast(n))  # one row


def heatmap(samples: DataFrame, direction: int = 0) -> DataFrame:
    """Mean occupancy by weekday (Monday 0) and hour in KST, all 7 x 24 cells."""
    local = F.floor(F.col("t") + KST)
    day = F.pmod(F.floor(local / DAY) + 3, F.lit(7)).cast("int")
    hour = F.floor(F.pmod(local, F.lit(DAY)) / 3600).cast("int")
    got = samples.filter(F.col("direction_index") == direction).groupBy(day.alias("weekday"), hour.alias("hour")).agg(F.round(F.avg("occupancy") + 1e-9, 4).alias("occupancy"))
    spark = samples.sparkSession
    grid = spark.range(7 * 24).select((F.col("id") / 24).cast("int").alias("weekday"), (F.col("id") % 24).cast("int").alias("hour"))
    return grid.join(got, ["weekday", "hour"], "left")


def latest_states(frames: DataFrame) -> DataFrame:
    """The newest row of each camera and direction."""
    fields = F.struct("t", "event_id", "occupancy", vehicles().alias("nv"))
    return frames.groupBy("camera_id", "direction_index").agg(F.max(fields).alias("s")).select("camera_id", "direction_index", "s.t", "s.occupancy", "s.nv", level(F.col("s.occupancy")).alias("level"))


def live_table(frames: DataFrame, cameras: DataFrame) -> DataFrame:
    """Every camera with its latest whole-camera state, if any."""
    state = latest_states(frames).filter("direction_index = 0").drop("direction_index")
    return cameras.select(F.col("id").alias("camera_id"), "name", "route", "region", "section", "enabled").join(state, "camera_id", "left")


def kpis(live: DataFrame) -> DataFrame:
    """Running cameras, mean occupancy, congested cameras, vehicles, worst camera."""
    worst = F.max(F.when(F.col("occupancy").isNotNull(), F.struct("occupancy", (-F.col("camera_id")).alias("k"))))
    out = live.agg(
        F.count_if(F.col("enabled")).alias("running"),
        F.round(F.avg("occupancy"), 10).alias("mean_occupancy"),
        F.count_if(F.col("level").isin(*LEVELS[2:])).alias("congested"),
        F.sum("nv").cast("long").alias("vehicles"),
        worst.alias("w"),
    )
    return out.select("running", "mean_occupancy", "congested", "vehicles", (-F.col("w.k")).alias("worst_camera"))


def trend(live: DataFrame, recent: DataFrame) -> DataFrame:
    """The latest state against the recent mean: flat within 0.01, else up or down."""
    rows = live.filter("occupancy is not null").join(recent.select("camera_id", F.col("occ").alias("mean")), "camera_id")
    diff = F.round(F.col("occupancy") - F.col("mean"), 10)
    return rows.select("camera_id", diff.alias("diff"), F.when(F.abs(diff) < 0.01, "flat").when(diff > 0, "up").otherwise("down").alias("trend"))


def history_wide(series: DataFrame, names: list[str], *keys: str) -> DataFrame:
    """Several histories side by side: one row per key and bucket, one column per series."""
    return series.groupBy(*keys, "bucket").pivot("series", names).agg(F.first("occupancy"))


def group_series(line: DataFrame, cameras: DataFrame, by: str, top: list[str] | DataFrame) -> DataFrame:
    """Mean over member cameras per bucket, of the chosen groups."""
    rows = line.join(cameras.select(F.col("id").alias("camera_id"), group_key(by).alias("group_name")), "camera_id")
    rows = rows.join(top, "group_name", "left_semi") if isinstance(top, DataFrame) else rows.filter(F.col("group_name").isin(top))
    return rows.groupBy("group_name", "bucket").agg(F.round(F.avg("occupancy"), 10).alias("occupancy"))


def stats_header(means: DataFrame, alerts: DataFrame) -> DataFrame:
    a = means.agg(F.round(F.avg("occ"), 10).alias("mean_occupancy"), F.count("*").alias("cameras"))
    b = alerts.agg(F.count("*").alias("alerts"), F.count_if("ongoing").alias("ongoing"))
    return a.crossJoin(b)  # two single rows


def ranking(states: DataFrame, by_direction: bool, measured: Column | None = None) -> DataFrame:
    """Places by occupancy, of whole cameras or of their measured directions."""
    rows = states.filter(F.col("direction_index") > 0 if by_direction else F.col("direction_index") == 0).filter("occupancy is not null")
    rows = rows if measured is None else rows.filter(measured)
    rows = rows.select("camera_id", "direction_index", "occupancy", "level")
    return ranked(rows, F.desc("occupancy"), F.asc("camera_id"), F.asc("direction_index"), name="place")


def level_counts(states: DataFrame) -> DataFrame:
    """Points by level, with zeros."""
    all_levels = states.sparkSession.createDataFrame([(i, x) for i, x in enumerate(LEVELS)], "level_no int, level string")
    got = states.filter("level is not null").groupBy("level").count().select("level", F.col("count").alias("points"))
    return all_levels.join(got, "level", "left").select("level_no", "level", F.coalesce("points", F.lit(0)).cast("long").alias("points"))


def needs_setup(cameras: DataFrame, directions: DataFrame, measured: DataFrame) -> DataFrame:
    """Cameras with a measured direction that has no heading."""
    missing = directions.filter("heading_deg is null").join(measured, ["camera_id", "index"], "left_semi")
    return cameras.join(missing, F.col("id") == F.col("camera_id"), "left_semi")


def filter_cameras(live: DataFrame, text: str = "", route: str | None = None, running: bool = False, level_name: str | None = None, sort: str = "occupancy") -> DataFrame:
    """Case-blind substring search over names and places, with filters; nulls sort last."""
    rows = live.filter(F.lower(F.concat_ws(" ", "name", "route", "region", "section")).contains(text.lower()))
    rows = rows if route is None else rows.filter(F.col("route") == route)
    rows = rows.filter("enabled") if running else rows
    rows = rows if level_name is None else rows.filter(F.col("level") == level_name)
    return rows.orderBy(F.coalesce(F.col(sort), F.lit(-1.0)).desc(), "camera_id")


def filter_points(states: DataFrame, level_name: str) -> DataFrame:
    """Cameras at a level, as a whole or in any direction."""
    per = states.groupBy("camera_id").agg(F.collect_list(F.struct("direction_index", "level")).alias("dirs"))
    return per.filter(F.exists("dirs", lambda d: d["level"] == level_name)).select("camera_id", F.size("dirs").cast("long").alias("n_states"))


def measured(road_px: Column, index: Column) -> Column:
    """Whether a direction has painted road pixels in a camera's map."""
    return F.coalesce(F.try_element_at(road_px, index.cast("string")), F.lit(0)) > 0


def by_road(directions: DataFrame, blank: str = "(도로 미지정)") -> DataFrame:
    """Directions of each camera by road name, the whole camera first."""
    road = F.coalesce(F.nullif(F.trim(F.col("road")), F.lit("")), F.lit(blank))
    return directions.groupBy("camera_id", road.alias("road")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("index")), lambda i: i.cast("string")), ",").alias("indexes"))
