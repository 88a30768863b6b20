"""The image manifest: clip names, conditions, polygons, matching and report tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.barrier import settled

#: Tokens of a clip name, hour bands, road forms by keyword, the easy condition,
#: and the sites' coordinates.
CLIP_FIELDS = ("site", "channel", "date", "time", "weekday", "cam_height", "hour_type", "road_type", "lane_config", "weather", "quality")
BANDS = ((7, 10, "07-09"), (10, 13, "10-12"), (13, 16, "13-15"), (16, 19, "16-18"), (19, 22, "19-21"))
FORM_KEYWORDS = (("tunnel", "tunnel"), ("brdg", "bridge"), ("bridge", "bridge"), ("overpass", "overpass"), ("shelter", "shelter"))
EASY = (("day_night", "day"), ("weather", "sunny"), ("road_form", "general"))
SITES = {
    "Suwon": (37.26, 127.03), "Gangneung": (37.75, 128.88), "Jeonju": (35.82, 127.15), "Buan": (35.73, 126.73), "Busan": (35.18, 129.08),
    "Chungju": (36.99, 127.93), "Cheonan": (36.81, 127.11), "Hongcheon": (37.70, 127.89), "Jincheon": (36.86, 127.44), "Inje": (38.07, 128.17),
}
ELSEWHERE = (36.5, 127.8)
TWILIGHT_MIN = 30


def parse_clip(rows: DataFrame, clip: str = "clip") -> DataFrame:
    """The eleven tokens of a clip name, empty where there are not exactly eleven."""
    out = settled(rows, _tokens=F.split(clip, "_"))
    t = F.col("_tokens")
    ok = F.size(t) == len(CLIP_FIELDS)
    out = out.withColumn("meta_parsed", ok)
    out = out.withColumns({n: F.when(ok, t[i]).otherwise("") for i, n in enumerate(CLIP_FIELDS)})
    lane = F.col("lane_config")
    return out.withColumns(
        {
            "camera": F.when(ok, F.concat_ws("_", "site", "channel")).otherwise(""),
            "cam_height_m": F.regexp_extract("cam_height", r"^([0-9.]+)m$", 1).try_cast("double"),
            "lane_direction": F.when(lane.startswith("TW"), "two_way").when(lane.startswith("OW"), "one_way").otherwise(""),
            "lane_count": F.regexp_extract(lane, r"^[A-Z]+(\d+)$", 1).try_cast("int"),
        }
    ).drop("_tokens")


def time_band(hhmm: Column) -> Column:
    hour = F.substring(hhmm, 1, 2).try_cast("int")
    out = F.when(hour.isNull(), "")
    for lo, hi, name in BANDS:
        out = out.when((hour >= lo) & (hour < hi), name)
    return out.otherwise("other")


def sun_minutes(date: Column, site: Column) -> tuple[Column, Column]:
    """(sunrise, sunset) in minutes of the local day, by the usual solar approximation."""
    lat = lon = None
    for name, (a, b) in SITES.items():
        lat = F.when(site == name, a) if lat is None else lat.when(site == name, a)
        lon = F.when(site == name, b) if lon is None else lon.when(site == name, b)
    lat, lon = lat.otherwise(ELSEWHERE[0]), lon.otherwise(ELSEWHERE[1])
    g = (F.dayofyear(date) - 1) * (2 * math.pi / 365)
    s, c = F.sin, F.cos
    equation = 229.18 * (0.000075 + 0.001868 * c(g) - 0.032077 * s(g) - 0.014615 * c(2 * g) - 0.040849 * s(2 * g))
    tilt = 0.006918 - 0.399912 * c(g) + 0.070257 * s(g) - 0.006758 * c(2 * g) + 0.000907 * s(2 * g) - 0.002697 * c(3 * g) + 0.00148 * s(3 * g)
    hour = math.cos(math.radians(90.833)) / (c(F.radians(lat)) * c(tilt)) - F.tan(F.radians(lat)) * F.tan(tilt)
    half = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), hour))))
    noon = 720 - 4 * lon - equation + 540
    return noon - 4 * half, noon + 4 * half


def minutes_of_day(hhmm: Column) -> Column:
    return F.substring(hhmm, 1, 2).try_cast("int") * 60 + F.substring(hhmm, 3, 2).try_cast("int")


def day_phase(t: Column, rise: Column, fall: Column) -> tuple[Column, Column]:
    """(day, twilight or night; minutes from sunset) at a minute of the day."""
    day = (t >= rise + TWILIGHT_MIN) & (t < fall - TWILIGHT_MIN)
    dusk = (F.abs(t - rise) <= TWILIGHT_MIN) | (F.abs(t - fall) <= TWILIGHT_MIN)
    return F.when(t.isNull() | rise.isNull(), "").when(day, "day").when(dusk, "twilight").otherwise("night"), F.bround(t - fall).cast("int")


def road_form(channel: Column) -> Column:
    out = None
    for word, form in FORM_KEYWORDS:
        hit = F.lower(channel).contains(word)
        out = F.when(hit, form) if out is None else out.when(hit, form)
    return out.otherwise("general")


def hard_reasons() -> Column:
    """The parts of the easy condition that a row misses, joined by a bar."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(F.col(k), F.lit("")) != v, F.concat(F.lit(f"{k}="), F.coalesce(F.col(k), F.lit("")))) for k, v in EASY])), "|")


def conditions(rows: DataFrame) -> DataFrame:
    """A parsed manifest with its derived condition columns."""
    date = F.try_to_timestamp("date", F.lit("yyyyMMdd")).cast("date")
    out = settled(rows, _date=date, _at=minutes_of_day(F.col("time")))
    rise, fall = sun_minutes(F.col("_date"), F.col("site"))
    out = settled(out, _rise=rise, _fall=fall)
    phase, from_sunset = day_phase(F.col("_at"), F.col("_rise"), F.col("_fall"))
    out = settled(out, day_night=phase, min_from_sunset=from_sunset).drop("_date", "_at", "_rise", "_fall")
    out = out.withColumns({"time_band": time_band(F.col("time")), "road_form": road_form(F.col("channel"))})
    out = settled(out, hard_reasons=hard_reasons())
    return out.withColumn("difficulty", F.when(F.col("hard_reasons") == "", "easy").otherwise("hard"))


#: The assembled manifest: one row an image.
MANIFEST = {
    "image_id": "string", "file_name": "string", "clip": "string", "region": "string", "image_archive": "string", "label_archive": "string", "zip_member": "string", "xml_member": "string",
    "width": "int", "height": "int", "xml_width": "int", "xml_height": "int", "size_scaled": "boolean", "resolution": "string", "orientation": "string", "src_mode": "string", "src_bytes": "bigint", "jpg_bytes": "bigint",
    "gt_car": "int", "gt_bus": "int", "gt_truck": "int", "gt_total": "int", "n_dropped_polygons": "int", "meta_parsed": "boolean", **dict.fromkeys(CLIP_FIELDS, "string"),
    "camera": "string", "cam_height_m": "double", "lane_direction": "string", "lane_count": "int", "day_night": "string", "min_from_sunset": "int", "time_band": "string", "road_form": "string", "hard_reasons": "string", "difficulty": "string", "frame": "int",
}


def build_manifest(images: DataFrame) -> DataFrame:
    """The manifest of matched images, with exactly the columns and types of ``MANIFEST``.

    ``images`` has stem, clip, where it comes from (region, image_archive, label_archive, zip_member, xml_member), its sizes and
    those of its labels, src_mode, src_bytes, jpg_bytes, objects a class (gt_) and n_dropped_polygons. The frame is the number at the
    stem's end; everything else follows from the sizes and the clip's name. A missing column is an error."""
    w, h = F.col("width"), F.col("height")
    rows = images.withColumns(
        {
            "image_id": F.col("stem"),
            "file_name": F.concat("stem", F.lit(".jpg")),
            "size_scaled": check_size(w, h, F.col("xml_width"), F.col("xml_height"))[1],
            "resolution": F.concat_ws("x", w.cast("string"), h.cast("string")),
            "orientation": F.when(w > h, "landscape").when(h > w, "portrait").otherwise("square"),
            "gt_total": F.col("gt_car") + F.col("gt_bus") + F.col("gt_truck"),
            "frame": F.regexp_extract("stem", r"(\d+)$", 1).try_cast("int"),
        }
    )
    return conditions(parse_clip(rows)).select(*(F.col(c).cast(t).alias(c) for c, t in MANIFEST.items()))


def read_kept_manifest(spark, path: str) -> DataFrame:
    """A manifest that was written by Parquet, checked against ``MANIFEST``; queries read the columns they need."""
    rows = spark.read.parquet(path)
    have = dict(rows.dtypes)
    wrong = [c for c, t in MANIFEST.items() if have.get(c) != t]
    if wrong:
        raise ValueError(f"not a manifest: {', '.join(wrong)}")
    return rows


def polygon_area_centroid(points: Column) -> Column:
    """Struct of area, cx, cy of an array of (x, y); a flat polygon has the mean of its vertices."""
    turned = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    cross = F.zip_with(points, turned, lambda p, q: F.struct((p["x"] * q["y"] - q["x"] * p["y"]).alias("c"), (p["x"] + q["x"]).alias("sx"), (p["y"] + q["y"]).alias("sy")))
    total = lambda f: F.aggregate(cross, F.lit(0.0), lambda acc, e: acc + f(e))
    mean = lambda k: F.aggregate(points, F.lit(0.0), lambda acc, e: acc + e[k]) / F.size(points)
    twice, sx, sy = total(lambda e: e["c"]), total(lambda e: e["c"] * e["sx"]), total(lambda e: e["c"] * e["sy"])
    flat = F.abs(twice) < 1e-12
    return F.struct((F.abs(twice) / 2).alias("area"), F.when(flat, mean("x")).otherwise(sx / (3 * twice)).alias("cx"), F.when(flat, mean("y")).otherwise(sy / (3 * twice)).alias("cy"))


def clean_polygon(points: Column, width: float, height: float, least_area: float) -> Column:
    """Points clamped to the image, without repeats and the closing point; null for fewer than three
    points or too small an area."""
    clamp = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), F.lit(float(top)))
    inside = F.transform(points, lambda p: F.struct(clamp(p["x"], width).alias("x"), clamp(p["y"], height).alias("y")))
    thin = F.filter(inside, lambda p, i: (i == 0) | (p != F.try_element_at(inside, i)))
    open_ = F.when((F.size(thin) > 1) & (thin[0] == F.element_at(thin, -1)), F.slice(thin, 1, F.size(thin) - 1)).otherwise(thin)
    return F.when((F.size(open_) >= 3) & (polygon_area_centroid(open_)["area"] >= least_area), open_)


def label_line(cls: Column, points: Column, width: float, height: float) -> Column:
    """``cls x y ...`` with coordinates as shares of the image, six decimals."""
    pair = F.transform(points, lambda p: F.format_string("%.6f %.6f", p["x"] / width, p["y"] / height))
    return F.concat_ws(" ", cls.cast("string"), F.array_join(pair, " "))


def label_lines(polygons: DataFrame, classes: tuple[str, ...], width: float, height: float, least_area: float) -> DataFrame:
    """Per image the text of its label file, objects a class, and polygons that were dropped, by reason.

    ``polygons`` has image_id, ord, label and points. A polygon of a class that is not in ``classes`` is dropped as
    unknown_class, one that :func:`clean_polygon` refuses as degenerate. Lines keep the order of ``ord``; an image all of whose polygons
    are dropped has an empty text."""
    number = F.array_position(F.array(*map(F.lit, classes)), F.col("label")) - 1
    rows = settled(polygons, cls=number, clean=clean_polygon(F.col("points"), width, height, least_area))
    known = F.coalesce(F.col("cls") >= 0, F.lit(False))
    good = known & F.col("clean").isNotNull()
    line = F.when(good, label_line(F.col("cls"), F.col("clean"), width, height))
    rows = rows.select("image_id", "ord", "cls", line.alias("line"), good.alias("good"), known.alias("known"))
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.col("good"), F.struct("ord", "line")))), lambda r: r["line"])
    counts = [F.count_if(F.col("good") & (F.col("cls") == k)).alias(f"n_{c}") for k, c in enumerate(classes)]
    return rows.groupBy("image_id").agg(F.array_join(lines, "\n").alias("text"), *counts, F.count_if(~F.col("known")).alias("unknown_class"), F.count_if(F.col("known") & ~F.col("good")).alias("degenerate"))


def match_images(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Images and labels of one key: the first label, and the first image by depth and name."""
    depth = F.size(F.split("path", "/"))
    i = images.withColumn("r", F.row_number().over(W.partitionBy("key").orderBy(depth, "path"))).filter("r = 1").select("key", F.col("path").alias("image"))
    b = labels.withColumn("r", F.row_number().over(W.partitionBy("key").orderBy("ord"))).filter("r = 1").select("key", F.col("path").alias("label"))
    return i.join(b, "key")


def unmatched(images: DataFrame, labels: DataFrame, examples: int = 100) -> DataFrame:
    """Counts of images without label, labels without image, and repeated ones of each, with
    the least ``examples`` keys of each kind."""
    lone = lambda a, b, kind: a.join(b, "key", "left_anti").select(F.lit(kind).alias("kind"), "key")
    twice = lambda a, kind: a.groupBy("key").agg((F.count("*") - 1).alias("n")).filter("n > 0").select(F.lit(kind).alias("kind"), F.explode(F.sequence(F.lit(1), "n")).alias("i"), "key").drop("i")
    rows = lone(images, labels, "image_without_label").unionByName(lone(labels, images, "label_without_image"))
    rows = rows.unionByName(twice(images, "repeated_image")).unionByName(twice(labels, "repeated_label"))
    counts = rows.groupBy("kind").agg(F.count("*").alias("n"))
    # a limit by sorting keeps the least keys of each part before they meet in one
    least = None
    for kind in ("image_without_label", "label_without_image", "repeated_image", "repeated_label"):
        top = rows.filter(F.col("kind") == kind).select("kind", "key").distinct().orderBy("key").limit(examples)
        least = top if least is None else least.unionByName(top)
    shown = least.groupBy("kind").agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("examples"))
    return counts.join(shown, "kind")


def check_size(width: Column, height: Column, label_width: Column, label_height: Column) -> tuple[Column, Column]:
    """(aspect ratios agree within 1 %, sizes differ)."""
    a, b = width / height, label_width / label_height
    return F.abs(a - b) / b <= 0.01, (width != label_width) | (height != label_height)


def stale_files(present: DataFrame, manifest: DataFrame) -> DataFrame:
    return present.join(manifest, "image_id", "left_anti")


def distributions(rows: DataFrame, attributes: list[str]) -> DataFrame:
    """Rows per value of each attribute, by one unpivot and one grouping."""
    long = rows.select(*(F.col(a).cast("string").alias(a) for a in attributes)).unpivot([], attributes, "attribute", "value")
    return long.groupBy("attribute", "value").agg(F.count("*").alias("n"))


def archive_kind(members: DataFrame) -> DataFrame:
    rows = members.groupBy("archive").agg(F.count_if(F.col("ext") == "xml").alias("xml"), F.count_if(F.col("ext") == "jpg").alias("img"))
    return rows.select("archive", F.when((F.col("xml") > 0) & (F.col("xml") >= F.col("img")), "label").when(F.col("img") > 0, "image").otherwise("unknown").alias("kind"))


def check_parts(parts: DataFrame) -> DataFrame:
    """Archives whose parts do not join up from offset 0, or differ at one offset."""
    clash = parts.groupBy("archive", "offset").agg(F.count_distinct("size").alias("sizes"), F.max("size").alias("size"))
    w = W.partitionBy("archive").orderBy("offset")
    rows = clash.withColumn("expected", F.coalesce(F.lag(F.col("offset") + F.col("size")).over(w), F.lit(0)))
    error = rows.groupBy("archive").agg(F.max(F.when(F.col("sizes") > 1, 1).otherwise(0)).alias("c"), F.max(F.when(F.col("offset") != F.col("expected"), 1).otherwise(0)).alias("g"))
    return error.filter("c + g > 0").select("archive", F.when(F.col("c") > 0, "size differs").otherwise("gap").alias("error"))
