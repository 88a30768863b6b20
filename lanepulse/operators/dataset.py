"""Dataset statistics and the leakage-safe split over the manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.kept import kept

CLASSES = ("car", "bus", "truck")


def class_counts(rows: DataFrame) -> DataFrame:
    """Objects, share of objects, and images with each class."""
    long = rows.unpivot(["image_id"], [f"n_{c}" for c in CLASSES], "cls", "n")
    out = long.groupBy("cls").agg(F.sum("n").cast("long").alias("objects"), F.count_if(F.col("n") > 0).alias("images"))
    return out.withColumn("share", F.round(F.col("objects") / F.sum("objects").over(W.partitionBy()), 10))  # three rows


def value_counts(rows: DataFrame, attribute: str, top: int | None = None) -> DataFrame:
    """Images and clips per value; beyond the ``top`` values one row of the others."""
    per = rows.groupBy(F.col(attribute).alias("value")).agg(F.count("*").alias("images"), F.count_distinct("clip").alias("clips"))
    if top is None:
        return per
    ranked = per.withColumn("r", F.row_number().over(W.orderBy(F.desc("images"), "value")))  # one row per value
    name = F.when(F.col("r") <= top, F.col("value")).otherwise("others")
    return ranked.groupBy(name.alias("value")).agg(F.sum("images").alias("images"), F.sum("clips").alias("clips"))


def objects_per_image(rows: DataFrame) -> DataFrame:
    long = rows.unpivot(["image_id"], [f"n_{c}" for c in CLASSES], "cls", "n")
    return long.groupBy("cls").agg(F.round(F.avg("n"), 10).alias("mean"), F.round(F.percentile("n", 0.5), 10).alias("median"), F.max("n").alias("max"), F.count_if(F.col("n") == 0).alias("zero"))


def object_size(polygons: DataFrame, small: float = 32**2, medium: float = 96**2) -> DataFrame:
    a = F.col("area_px")
    share = lambda c: F.round(F.avg(c.cast("int")), 10)
    return polygons.groupBy("cls").agg(share(a < small).alias("small"), share((a >= small) & (a < medium)).alias("medium"), share(a >= medium).alias("large"), F.round(F.percentile("area_px", 0.5), 8).alias("median_px"))


def area_ratio(rows: DataFrame, attribute: str) -> DataFrame:
    """Vehicle area ratio overall and per value, by grouping sets."""
    rows = rows.withColumn("value", F.col(attribute))
    out = rows.groupingSets([["value"], []], "value").agg(F.grouping("value").alias("g"), F.count("*").alias("n"), F.round(F.avg("ratio"), 10).alias("mean"), F.round(F.percentile("ratio", 0.5), 8).alias("median"), F.round(F.percentile("ratio", 0.95), 8).alias("p95"), F.max("ratio").alias("max"))
    return out.select(F.when(F.col("g") == 1, "(all)").otherwise(F.col("value")).alias("value"), "n", "mean", "median", "p95", "max")


def centroid_hist(polygons: DataFrame, bx: int = 64, by: int = 36) -> DataFrame:
    """Shares of centroids in a grid whose last bins are closed."""
    cell = lambda c, n: F.least(F.floor(F.col(c) * n), F.lit(n - 1)).cast("int")
    per = polygons.groupBy(cell("cx", bx).alias("bx"), cell("cy", by).alias("by")).agg(F.count("*").alias("n"))
    return per.select("bx", "by", F.round(100 * F.col("n") / F.sum("n").over(W.partitionBy()), 9).alias("percent"))  # at most bx * by rows


def frames_per_clip(rows: DataFrame) -> DataFrame:
    per = rows.groupBy("clip").count()
    return per.agg(F.count("*").alias("clips"), F.round(F.avg("count"), 10).alias("mean"), F.min("count").alias("min"), F.max("count").alias("max"))


def group_stats(rows: DataFrame, by: str) -> DataFrame:
    """The table of metrics per value of a column; null values are a group. Class shares are null where there are no objects."""
    n = sum((F.col(f"n_{c}") for c in CLASSES), F.lit(0))
    rows = rows.withColumn("n_objects", n)
    out = rows.groupBy(F.col(by).alias("value")).agg(
        F.count("*").alias("images"), F.count_distinct("clip").alias("clips"), F.count_distinct("camera").alias("cameras"), F.sum("n_objects").cast("long").alias("objects"),
        *(F.round(F.try_divide(F.sum(f"n_{c}"), F.sum("n_objects")), 10).alias(f"{c}_share") for c in CLASSES),
        F.round(F.avg("n_objects"), 10).alias("mean"), F.round(F.percentile("n_objects", 0.5), 10).alias("median"), F.max("n_objects").cast("long").alias("max"),
        F.round(F.avg((F.col("n_objects") == 0).cast("int")), 10).alias("empty"),
    )
    whole = out.agg(F.sum("images").alias("of_all"))  # one row
    return out.join(F.broadcast(whole)).withColumn("share", F.round(F.col("images") / F.col("of_all"), 10)).drop("of_all")


def class_by_attr(rows: DataFrame, attribute: str) -> DataFrame:
    per = rows.groupBy(F.col(attribute).alias("value")).agg(*(F.sum(f"n_{c}").alias(c) for c in CLASSES))
    total = sum((F.col(c) for c in CLASSES), F.lit(0))
    return per.select("value", *(F.round(F.try_divide(F.col(c), total), 10).alias(c) for c in CLASSES))


def camera_stats(rows: DataFrame) -> DataFrame:
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",").alias(f"{c}s")
    return rows.groupBy("camera").agg(F.count("*").alias("images"), F.count_distinct("clip").alias("clips"), joined("weather"), joined("day_night"), F.count_if(F.col("difficulty") == "easy").alias("easy"), F.count_if(F.col("difficulty") == "hard").alias("hard"))


def cross(rows: DataFrame, a: str, b: str, values: list[str]) -> DataFrame:
    """Images / clips per cell of two attributes."""
    cell = F.concat_ws(" / ", F.count("clip").cast("string"), F.count_distinct("clip").cast("string"))
    return rows.groupBy(F.col(a).alias("value")).pivot(b, values).agg(cell)


def difficulty_stats(rows: DataFrame, top: int = 12) -> DataFrame:
    """Levels, single reasons and the commonest whole combinations with images, clips and cameras,
    from one pass: each row stands under its level, its combination and each of its reasons."""
    entry = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    reasons = F.when(F.col("hard_reasons") == "", F.array().cast("array<string>")).otherwise(F.split("hard_reasons", r"\|"))
    entries = F.concat(F.array(entry("level", F.col("difficulty")), entry("combination", F.col("hard_reasons"))), F.transform(reasons, lambda r: entry("reason", r)))
    long = rows.select("clip", "camera", F.inline(entries))
    counted = long.groupBy("kind", "value").agg(F.count("*").alias("images"), F.count_distinct("clip").alias("clips"), F.count_distinct("camera").alias("cameras"))
    # one row per value of three conditions
    ranked = counted.withColumn("rank", F.row_number().over(W.partitionBy("kind").orderBy(F.desc("images"), "value")))
    return ranked.filter((F.col("kind") != "combination") | (F.col("rank") <= top)).drop("rank")


def paired_hours(rows: DataFrame) -> DataFrame:
    """Cameras with clips in normal and rush hours: mean objects of each, and the difference."""
    n = sum((F.col(f"n_{c}") for c in CLASSES), F.lit(0))
    per = rows.groupBy("camera", "hour_type").agg(F.avg(n).alias("m"))
    wide = per.groupBy("camera").pivot("hour_type", ["NH", "RH"]).agg(F.first("m")).filter("NH is not null and RH is not null")
    return wide.select("camera", F.round("NH", 10).alias("nh"), F.round("RH", 10).alias("rh"), F.round(F.col("RH") - F.col("NH"), 10).alias("diff"))


def token_table(rows: DataFrame, tokens: list[str]) -> DataFrame:
    long = rows.select("clip", *tokens).unpivot(["clip"], tokens, "token", "value")
    return long.groupBy("token").agg(F.count_distinct("value").alias("distinct"), F.min("value").alias("min"), F.max("value").alias("max"))


def diverse_sample(rows: DataFrame, k: int, seed: int) -> DataFrame:
    """``k`` images per phase: one per clip, new sites first, by a seeded hash."""
    key = F.xxhash64(F.col("image_id"), F.lit(seed))
    one = rows.withColumn("h", key).withColumn("r", F.row_number().over(W.partitionBy("day_night", "clip").orderBy("h", "image_id"))).filter("r = 1")
    site = one.withColumn("s", F.row_number().over(W.partitionBy("day_night", "site").orderBy("h", "image_id")))
    return site.withColumn("p", F.row_number().over(W.partitionBy("day_night").orderBy("s", "h", "image_id"))).filter(F.col("p") <= k).select("day_night", "image_id", "clip", "site")


def class_weights(counts: DataFrame, alpha: float = 0.5) -> DataFrame:
    """How rare each class is beside the first one, to the power of ``alpha``; no class counts as one object."""
    n = F.greatest("objects", F.lit(1))
    ref = F.max(F.when(F.col("cls").endswith(CLASSES[0]), n)).over(W.partitionBy())  # three rows
    return counts.select("cls", F.round(F.pow(ref / n, alpha), 10).alias("weight"))


def even_pick(rows: DataFrame, k: str) -> DataFrame:
    """``k`` frames of each clip: equal slices of its order, the best score of each (then the
    nearest to the slice's middle, then the first)."""
    return _slices(rows, k, "clip").filter((F.col(k) > 0) & (F.col("_best") == 1)).select("clip", "image_id", F.col("_part").cast("long").alias("part"))


def _slices(rows: DataFrame, k: str, *by: str) -> DataFrame:
    """``rows`` with the slice ``_part`` of their group and the place ``_best`` in it (none where ``k`` is null or 0)."""
    w = W.partitionBy(*by)
    r = rows.withColumn("_pos", F.row_number().over(w.orderBy("frame", "image_id")) - 1).withColumn("_n", F.count("*").over(w))
    r = r.withColumn("_part", F.when(F.col(k) > 0, F.least(F.floor(F.col("_pos") * F.col(k) / F.col("_n")), F.col(k) - 1)))
    mid = F.abs(F.col("_pos") + 0.5 - (F.col("_part") + 0.5) * F.col("_n") / F.col(k))
    pick = W.partitionBy(*by, "_part").orderBy(F.desc("score"), F.round(mid, 9), "_pos")
    return r.withColumn("_best", F.row_number().over(pick)).drop("_pos", "_n")


def leak_risk(rows: DataFrame, guard: int = 10) -> DataFrame:
    """-1 for held-out frames, 0 in clips without any, 2 within ``guard`` frames of one, else 1."""
    return with_leak_risk(rows, guard).select("clip", "image_id", "risk")


def with_leak_risk(rows: DataFrame, guard: int = 10) -> DataFrame:
    """``rows`` with ``risk``, see :func:`leak_risk`."""
    w = W.partitionBy("clip").orderBy("frame", "image_id")
    pos = rows.withColumn("_pos", F.row_number().over(w))
    mark = F.when(F.col("held"), F.col("_pos"))
    # the next one is the last one in falling order: both ways a frame is looked at once
    before, after = F.last(mark, True).over(w), F.last(mark, True).over(W.partitionBy("clip").orderBy(F.desc("_pos")))
    gap = F.least(F.coalesce(F.col("_pos") - before, F.lit(1 << 30)), F.coalesce(after - F.col("_pos"), F.lit(1 << 30)))
    return pos.withColumn("risk", F.when(F.col("held"), -1).when(gap == 1 << 30, 0).when(gap <= guard, 2).otherwise(1)).drop("_pos")


def select_priority(rows: DataFrame) -> DataFrame:
    """Risky frames count as safe where their camera, weather and phase has no safe frame."""
    return with_priority(rows).select("image_id", "priority")


def with_priority(rows: DataFrame) -> DataFrame:
    """``rows`` with ``priority``, see :func:`select_priority`."""
    keys = ["camera", "weather", "day_night"]
    safe = rows.filter("risk = 0").select(*keys).distinct().withColumn("_has", F.lit(True))
    out = rows.join(safe, keys, "left")
    return out.select(*rows.columns, F.when((F.col("risk") == 1) & F.col("_has").isNull(), 0).otherwise(F.col("risk")).alias("priority"))


def coverage_table(rows: DataFrame, splits: list[str]) -> DataFrame:
    return rows.groupBy("camera").pivot("split", splits).agg(F.count("split")).na.fill(0)


def split_sizes(rows: DataFrame) -> DataFrame:
    n = sum((F.col(f"n_{c}") for c in CLASSES), F.lit(0))
    return rows.groupBy("split").agg(F.count("*").alias("images"), F.count_distinct("clip").alias("clips"), F.count_distinct("camera").alias("cameras"), F.round(F.avg((F.col("difficulty") == "hard").cast("int")), 10).alias("hard"), F.sum(n).cast("long").alias("objects"))


def split_distribution(rows: DataFrame, attributes: list[str]) -> DataFrame:
    """Share of each value within each set, and how far it is from the whole at most."""
    long = rows.select("split", *attributes).unpivot(["split"], attributes, "attribute", "value")
    per = long.groupBy("attribute", "value", "split").agg(F.count("*").alias("n"))
    share = per.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("attribute", "split")))
    whole = per.groupBy("attribute", "value").agg(F.sum("n").alias("n")).withColumn("whole", F.col("n") / F.sum("n").over(W.partitionBy("attribute")))
    out = share.join(whole.drop("n"), ["attribute", "value"])
    return out.groupBy("attribute", "value").agg(F.round(F.first("whole"), 10).alias("whole"), F.round(F.max(F.abs(F.col("share") - F.col("whole"))), 10).alias("max_deviation"))


def seeded_pick(rows: DataFrame, k: int, seed: int, key: str) -> DataFrame:
    """The same random ``k`` keys for everyone."""
    return rows.select(key).distinct().orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(k)


def image_brightness(pixels: DataFrame) -> DataFrame:
    """Mean and deviation of each image's grey pixel values."""
    return pixels.groupBy("image").agg(F.round(F.avg("grey"), 8).alias("mean"), F.round(F.stddev_pop("grey"), 8).alias("std"))


def natural_order(value: Column) -> Column:
    """A sort key that puts numbers inside names in numeric order."""
    return F.lpad(F.regexp_extract(value, r"(\d+)", 1), 12, "0")


def vertices(polygons: DataFrame) -> DataFrame:
    """Vertices per polygon and class, with the 99.5th percentile that plots are cut at."""
    return polygons.groupBy("cls").agg(F.round(F.percentile("n", 0.5), 8).alias("median"), F.round(F.avg("n"), 10).alias("mean"), F.max("n").alias("max"), F.round(F.percentile("n", 0.995), 8).alias("cut"))


def overlap_summary(rows: DataFrame) -> DataFrame:
    """Overlap by bins of the number of objects (``n_objects``, ``overlap``)."""
    n = F.col("n_objects")
    name = F.when(n <= 1, "0-1").when(n <= 3, "2-3").when(n <= 6, "4-6").otherwise("7+")
    return rows.groupBy(name.alias("bin")).agg(F.count("*").alias("images"), F.round(F.avg("overlap"), 10).alias("mean"), F.round(F.percentile("overlap", 0.5), 8).alias("median"), F.count_if(F.col("overlap") > 0.05).alias("over_5_percent"))


def share_table(rows: DataFrame, attribute: str) -> DataFrame:
    """Images, their share, clips and cameras per value."""
    per = rows.groupBy(F.col(attribute).alias("value")).agg(F.count("*").alias("images"), F.count_distinct("clip").alias("clips"), F.count_distinct("camera").alias("cameras"))
    return per.withColumn("share", F.round(F.col("images") / F.sum("images").over(W.partitionBy()), 10))  # one row per value


def spec_numeric(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Minimum, median, mean, maximum and sum of numeric columns, by one unpivot."""
    long = rows.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], columns, "name", "v")
    return long.groupBy("name").agg(F.min("v").alias("min"), F.round(F.percentile("v", 0.5), 8).alias("median"), F.round(F.avg("v"), 6).alias("mean"), F.max("v").alias("max"), F.round(F.sum("v"), 3).alias("sum"))


def spec_compare(rows: DataFrame, spec: DataFrame) -> DataFrame:
    """Shares of images and clips whose value a published specification lists (attribute, values)."""
    names = [r[0] for r in spec.select("attribute").collect()]  # a few attributes of a fixed table
    long = rows.select("clip", *names).unpivot(["clip"], names, "attribute", "value")
    hit = long.join(F.broadcast(spec), "attribute").withColumn("hit", F.array_contains("values", F.col("value")))
    return hit.groupBy("attribute").agg(F.round(F.avg(F.col("hit").cast("int")), 10).alias("images"), F.round(F.count_distinct(F.when(F.col("hit"), F.col("clip"))) / F.count_distinct("clip"), 10).alias("clips"))


def condition_matrix(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Share of all images per cell, with images and clips."""
    per = rows.groupBy(F.col(a).alias("row"), F.col(b).alias("col")).agg(F.count("*").alias("images"), F.count_distinct("clip").alias("clips"))
    return per.withColumn("share", F.round(F.col("images") / F.sum("images").over(W.partitionBy()), 10))  # one row per cell


def before_after(before: DataFrame, after: DataFrame, attribute: str) -> DataFrame:
    """Images per value before and after a selection."""
    count = lambda rows, name: rows.groupBy(F.col(attribute).alias("value")).agg(F.count("*").alias(name))
    out = count(before, "before").join(count(after, "after"), "value", "full")
    return out.select("value", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))


def integrity(labels: DataFrame, images: DataFrame, classes: int) -> DataFrame:
    """Problems of label lines (image_id, line_no, tokens) and of files, one row each kind and image."""
    cls = F.col("tokens")[0].try_cast("int")
    numbers = F.transform(F.slice("tokens", 2, F.greatest(F.size("tokens") - 1, F.lit(0))), lambda t: t.try_cast("double"))
    rows = labels.select("image_id", cls.alias("cls"), numbers.alias("xy"))
    kind = F.when(F.col("cls").isNull() | F.exists("xy", lambda v: v.isNull()), "unparsable")
    kind = kind.when((F.col("cls") < 0) | (F.col("cls") >= classes), "unknown_class").when((F.size("xy") < 6) | (F.size("xy") % 2 == 1), "bad_count").when(F.exists("xy", lambda v: (v < 0) | (v > 1)), "out_of_range")
    bad = rows.select("image_id", kind.alias("kind")).filter("kind is not null")
    lone = labels.select("image_id").distinct().join(images, "image_id", "left_anti").select("image_id", F.lit("orphan_label").alias("kind"))
    bare = images.select("image_id").distinct().join(labels, "image_id", "left_anti").select("image_id", F.lit("missing_label").alias("kind"))
    return bad.unionByName(lone).unionByName(bare).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("image_id").alias("images"))


#: The order in which values of an attribute are shown; others follow by name.
VALUE_ORDER = {
    "weekday": ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN"),
    "day_night": ("day", "twilight", "night"),
    "road_form": ("general", "bridge", "tunnel", "overpass", "shelter"),
    "weather": ("sunny", "rainy", "fog", "snow", "tunnel"),
    "difficulty": ("easy", "hard"),
}


def attr_stats(rows: DataFrame, attribute: str) -> DataFrame:
    """:func:`group_stats` of an attribute with each value's place: by images for sites and cameras,
    by metres for heights, in a fixed order where there is one, else by value."""
    out = group_stats(rows, attribute)
    if attribute in ("site", "camera"):
        first = -F.col("images")
    elif attribute == "cam_height":
        first = F.coalesce(F.rtrim("value", F.lit("m")).try_cast("double"), F.lit(0.0))
    else:
        known = F.array(*map(F.lit, VALUE_ORDER.get(attribute, ("",))))
        first = F.coalesce(F.nullif(F.array_position(known, F.col("value")), F.lit(0)), F.lit(len(VALUE_ORDER.get(attribute, ())) + 1))
    return out.withColumn("place", F.row_number().over(W.orderBy(first, "value")))  # one row per value of the attribute


def clip_stats(rows: DataFrame, attributes: list[str]) -> DataFrame:
    """:func:`group_stats` per clip, with the clip's attributes (the least value of each)."""
    info = rows.groupBy(F.col("clip").alias("value")).agg(*(F.min(a).alias(a) for a in attributes))
    return group_stats(rows, "clip").drop("clips", "cameras").join(info, "value").withColumnRenamed("value", "clip")


def polygon_table(polygons: DataFrame, imgsz: int) -> DataFrame:
    """Areas of polygons (image_id, line_no, cls, points as shares of the image, width, height): as a
    share of the image, in its pixels, and in pixels at the training size of the longer side."""
    from .manifest import polygon_area_centroid

    rows = polygons.withColumn("area_norm", polygon_area_centroid(F.col("points"))["area"])
    px = F.col("area_norm") * F.col("width") * F.col("height")
    scale = F.lit(float(imgsz)) / F.greatest("width", "height")
    return rows.select("image_id", "line_no", "cls", F.size("points").alias("n_vertices"), "area_norm", px.alias("area_px"), (px * scale * scale).alias("area_train_px"))


def class_stats(rows: DataFrame, polygons: DataFrame, small: float = 32**2, medium: float = 96**2) -> DataFrame:
    """The class table: objects and their share, images, clips and cameras with the class, objects an
    image, imbalance against cars, sizes and vertices. ``polygons`` has cls (name) and the columns of
    :func:`polygon_table`; a class without polygons has zero objects and null sizes."""
    long = rows.unpivot(["clip", "camera"], [f"n_{c}" for c in CLASSES], "cls", "n").withColumn("cls", F.substring_index("cls", "_", -1))
    holds = lambda c: F.count_distinct(F.when(F.col("n") > 0, F.col(c))).alias(f"{c}s_with")
    per = long.groupBy("cls").agg(
        F.count_if(F.col("n") > 0).alias("images_with"), F.round(F.avg((F.col("n") > 0).cast("int")), 10).alias("images_share"), holds("clip"), holds("camera"),
        F.round(F.avg("n"), 10).alias("per_image_mean"), F.max("n").cast("long").alias("per_image_max"),
    )
    a = F.col("area_train_px")
    share = lambda c, n: F.round(F.avg(c.cast("int")), 10).alias(n)
    sizes = polygons.groupBy("cls").agg(
        F.count("*").alias("k"), share(a < small, "small"), share((a >= small) & (a < medium), "medium"), share(a >= medium, "large"),
        F.round(F.percentile("area_norm", 0.5), 8).alias("area_median"), F.round(F.percentile("area_px", 0.5), 6).alias("area_median_px"),
        F.percentile("n_vertices", 0.5).alias("vertices_median"), F.max("n_vertices").cast("long").alias("vertices_max"),
    )
    out = per.join(F.broadcast(sizes), "cls", "left").withColumn("objects", F.coalesce("k", F.lit(0))).drop("k")  # a row per class
    w = W.partitionBy()  # three rows
    cars = F.max(F.when(F.col("cls") == "car", F.col("objects"))).over(w)
    total = F.greatest(F.sum("objects").over(w), F.lit(1))
    return out.withColumn("object_share", F.round(F.col("objects") / total, 10)).withColumn("imbalance", F.round(cars / F.greatest("objects", F.lit(1)), 8))


def brightness_summary(rows: DataFrame, darkest: int = 5) -> DataFrame:
    """Median brightness per phase of day and per weather, and the clips of the least mean brightness."""
    entry = lambda k: F.struct(F.lit(k).alias("kind"), F.col(k).alias("value"))
    long = rows.select("brightness", F.inline(F.array(entry("day_night"), entry("weather")))).filter("value <> ''")
    medians = long.groupBy("kind", "value").agg(F.count("*").alias("n"), F.round(F.percentile("brightness", 0.5), 6).alias("brightness"))
    clips = rows.groupBy("clip").agg(F.count("*").alias("n"), F.round(F.avg("brightness"), 6).alias("brightness"))
    dark = clips.orderBy("brightness", "clip").limit(darkest)
    return medians.unionByName(dark.select(F.lit("clip").alias("kind"), F.col("clip").alias("value"), "n", "brightness"))


def quality_stats(rows: DataFrame) -> DataFrame:
    """Images and cameras per resolution and orientation; over all also the median file size, the
    total and the ratio to the source files, by grouping sets."""
    kb = F.col("jpg_bytes") / 1024
    out = rows.groupingSets([["resolution"], ["orientation"], []], "resolution", "orientation").agg(
        F.grouping_id().alias("g"), F.count("*").alias("images"), F.count_distinct("camera").alias("cameras"), F.round(F.percentile(kb, 0.5), 4).alias("median_kb"),
        F.round(F.sum(kb) / 1024**2, 8).alias("total_gb"), F.round(F.sum("jpg_bytes") / F.sum("src_bytes"), 8).alias("ratio"),
    )
    kind = F.when(F.col("g") == 1, "resolution").when(F.col("g") == 2, "orientation").otherwise("all")
    return out.select(kind.alias("kind"), F.coalesce("resolution", "orientation", F.lit("")).alias("value"), "images", "cameras", "median_kb", "total_gb", "ratio")


def _draw(seed: int, salt: str, below: Column) -> Column:
    """A whole number from 0 to below - 1 that depends on the clip and the seed alone."""
    text = F.concat_ws("|", F.col("clip").cast("string"), F.lit(str(seed)), F.lit(salt))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), below)


def place_blocks(clips: DataFrame, seed: int) -> DataFrame:
    """Runs of frames within each clip (``clip``, ``n_frames``, ``quota_a``, ``quota_b``): one run lies
    anywhere; with a ``quota_b`` one lies in the front and one in the back half of what is left over,
    either first. Quotas beyond the clip are cut, the larger first. Ends are exclusive."""
    n = F.col("n_frames")
    qa, qb = F.greatest("quota_a", F.lit(0)), F.when(F.col("quota_b").isNotNull(), F.greatest("quota_b", F.lit(0)))
    over, apart = qa + qb - n, F.abs(qa - qb)
    a = F.when(qb.isNull(), F.least(qa, n)).when(over <= 0, qa).when(over > apart, F.floor(n / 2)).otherwise(F.when(qa >= qb, qa - over).otherwise(qa))
    b = F.when(over <= 0, qb).when(over > apart, n - F.floor(n / 2)).otherwise(F.when(qa >= qb, qb).otherwise(qb - over))
    rows = clips.withColumn("a", a.cast("long")).withColumn("b", b.cast("long"))
    slack = F.floor((n - F.col("a") - F.col("b")) / 2) + 1
    rows = rows.withColumn("a_first", _draw(seed, "side", F.lit(2)) == 0).withColumn("front", _draw(seed, "front", slack)).withColumn("back", n - _draw(seed, "back", slack))
    start_a = F.when(F.col("b").isNull(), _draw(seed, "front", n - F.col("a") + 1)).when(F.col("a_first"), F.col("front")).otherwise(F.col("back") - F.col("a"))
    start_b = F.when(F.col("b").isNotNull(), F.when(F.col("a_first"), F.col("back") - F.col("b")).otherwise(F.col("front")))
    rows = rows.withColumn("start_a", start_a).withColumn("start_b", start_b)
    return rows.select("clip", "start_a", (F.col("start_a") + F.col("a")).alias("end_a"), "start_b", (F.col("start_b") + F.col("b")).alias("end_b"))


#: The order in which a camera's training quota is filled, by difficulty and leak priority.
TIERS = (("hard", 0), ("hard", 1), ("easy", 0), ("easy", 1), ("hard", 2), ("easy", 2))


def reduce_train(rows: DataFrame, quotas: DataFrame, keep_easy: bool = True) -> DataFrame:
    """What becomes of each frame of the training pool: hard, easy_fill, dropped_hard or dropped_easy.

    ``rows`` has camera, clip, image_id (unique), frame, difficulty, priority and score; ``quotas`` one
    quota a camera (none: 0). Tiers fill the quota in order; a tier that does not fit whole is shared
    among its clips by largest remainder (then the least clip), and each clip's frames are picked
    evenly. Windows run over counts per clip, not over frames, but for the picks within a clip."""
    return with_selection(rows, quotas, keep_easy).select("image_id", "camera", "difficulty", "selection")


def with_selection(rows: DataFrame, quotas: DataFrame, keep_easy: bool = True) -> DataFrame:
    """``rows`` with ``selection``, see :func:`reduce_train`: a frame stays in its row, and moves once, to its clip and tier."""
    tier = F.lit(None).cast("int")
    for i, (difficulty, priority) in enumerate(TIERS):
        if keep_easy or difficulty == "hard":
            tier = F.when((F.col("difficulty") == difficulty) & (F.col("priority") == priority), i).otherwise(tier)
    pool = rows.withColumn("tier", tier)
    sizes = pool.filter("tier is not null").groupBy("camera", "tier", "clip").agg(F.count("*").alias("size"))
    per = sizes.groupBy("camera", "tier").agg(F.sum("size").alias("total"))
    before = F.coalesce(F.sum("total").over(W.partitionBy("camera").orderBy("tier").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("before", before).join(quotas.select("camera", "quota"), "camera", "left")  # six rows a camera
    k = F.greatest(F.least(F.coalesce("quota", F.lit(0)) - F.col("before"), F.col("total")), F.lit(0))
    shares = sizes.join(per.select("camera", "tier", "total", k.alias("k")), ["camera", "tier"])
    shares = shares.withColumn("base", F.floor(F.col("k") * F.col("size") / F.col("total"))).withColumn("rest", F.col("k") * F.col("size") - F.col("base") * F.col("total"))
    w = W.partitionBy("camera", "tier")
    more = F.row_number().over(w.orderBy(F.desc("rest"), "clip")) <= F.col("k") - F.sum("base").over(w)
    shares = shares.select("camera", "tier", "clip", (F.col("base") + more.cast("int")).alias("k"))
    slots = ["camera", "tier", "clip"]
    out = _slices(pool.join(shares.filter("k > 0"), slots, "left"), "k", *slots)
    kept = F.when(F.col("difficulty") == "hard", "hard").otherwise("easy_fill")
    taken = (F.col("k") > 0) & (F.col("_best") == 1)
    return out.select(*rows.columns, F.when(taken, kept).otherwise(F.concat(F.lit("dropped_"), "difficulty")).alias("selection"))


def reduction_report(selection: DataFrame, quotas: DataFrame) -> DataFrame:
    """Per camera: the pool, its quota, what was selected and what is missing."""
    n = lambda c, name: F.count_if(c).alias(name)
    chosen = F.col("selection")
    out = selection.groupBy("camera").agg(F.count("*").alias("pool"), n(F.col("difficulty") == "hard", "pool_hard"), n(chosen == "hard", "selected_hard"), n(chosen == "easy_fill", "selected_easy"))
    out = out.join(quotas.select("camera", "quota"), "camera", "left").withColumn("quota", F.coalesce("quota", F.lit(0)))
    return out.withColumn("shortfall", F.col("quota") - F.col("selected_hard") - F.col("selected_easy"))


def assign_split(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Frames with their set: those in a clip's runs of :func:`place_blocks` are val (a) and test (b),
    by their place in the order of the clip; all others, and clips without runs, are train."""
    place = F.row_number().over(W.partitionBy("clip").orderBy("frame", "image_id")) - 1
    out = rows.select("clip", "image_id", "frame").withColumn("place", place).join(blocks, "clip", "left")
    within = lambda k: (F.col("place") >= F.col(f"start_{k}")) & (F.col("place") < F.col(f"end_{k}"))
    return out.select("clip", "image_id", "frame", F.when(within("a"), "val").when(within("b"), "test").otherwise("train").alias("split"))


def clip_ranges(rows: DataFrame) -> DataFrame:
    """Frames and their range per clip and set."""
    return rows.groupBy("clip", "split").agg(F.count("*").alias("frames"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))


#: Conditions whose shares the findings name, and the pixels below which an object is small.
NOTED = {"day_night": ("day", "night", "twilight"), "weather": ("sunny", "rainy", "fog", "snow", "tunnel"), "road_form": ("general", "bridge", "tunnel", "overpass", "shelter")}
SMALL_PX = 32.0**2


def findings(rows: DataFrame, polygons: DataFrame) -> DataFrame:
    """(finding, name, value): what stands out in a dataset, one row a number.

    ``rows`` is a manifest with brightness and overlap; ``polygons`` has cls and area_train_px. Findings: class_share and bus_images
    (of images), small_objects (of all and by class), day_night, weather and road_form shares, night_clips by site, easy (images, share,
    hard images, cameras with easy images only), few_clips (cameras with one or two, each with its clips), bus_sites (the three
    sites with most buses, and their share), brightness (median by phase), overlap (mean of images with two objects or
    more), paired_hours (rush-hour clips, cameras with both kinds, and those with more objects in rush hours), and empty_images.

    Images are summed once, by clip and its conditions; all rules but the medians read those sums. Shares of nothing are null."""
    n = sum((F.col(f"n_{c}") for c in CLASSES), F.lit(0))
    keys = ["clip", "camera", "site", "day_night", "weather", "road_form", "difficulty", "hour_type"]
    many = n >= 2
    base = rows.groupBy(*keys).agg(
        F.count("*").alias("images"), *(F.sum(f"n_{c}").alias(c) for c in CLASSES), F.count_if(F.col("n_bus") > 0).alias("with_bus"), F.count_if(n == 0).alias("empty"),
        F.count_if(many).alias("many"), F.sum(F.when(many, F.col("overlap"))).alias("overlap"),
    )
    base = kept(base, "findings")
    objects = sum((F.sum(c) for c in CLASSES), F.lit(0))
    when = lambda c, v: F.sum(F.when(c, F.col(v)))
    of = lambda a, b: F.try_divide(F.coalesce(a, F.lit(0)), b)
    total = F.sum("images")
    clips = lambda c: F.count_distinct(F.when(c, F.col("clip")))
    by_camera = base.groupBy("camera").agg(F.count_distinct("clip").alias("clips"), F.count_if(F.col("difficulty") != "easy").alias("hard"))
    numbers = {("class_share", c): of(F.sum(c), objects) for c in CLASSES}
    numbers |= {("bus_images", ""): of(F.sum("with_bus"), total), ("empty_images", ""): F.sum("empty"), ("overlap", ""): of(F.sum("overlap"), F.sum("many"))}
    numbers |= {(a, v): of(when(F.col(a) == v, "images"), total) for a, vs in NOTED.items() for v in vs}
    easy = F.col("difficulty") == "easy"
    numbers |= {("easy", "images"): when(easy, "images"), ("easy", "share"): of(when(easy, "images"), total), ("easy", "hard_images"): when(~easy, "images")}
    numbers |= {("paired_hours", "rush_clips"): clips(F.col("hour_type") == "RH")}
    listed = lambda rows, what: rows.select(F.inline(F.array(*(F.struct(F.lit(f).alias("finding"), F.lit(name).alias("name"), F.coalesce(v, F.lit(0.0)).alias("value") if f != "overlap" else v.alias("value")) for (f, name), v in what.items()))))
    one = base.agg(*(c.cast("double").alias(f"v{k}") for k, c in enumerate(numbers.values())))  # a single row
    out = listed(one, {key: F.col(f"v{k}") for k, key in enumerate(numbers)})
    row = lambda rows, finding, name, value: rows.select(F.lit(finding).alias("finding"), name.cast("string").alias("name"), value.cast("double").alias("value"))
    out = out.unionByName(row(by_camera.filter("hard = 0").agg(F.count("*").alias("n")), "easy", F.lit("cameras_easy_only"), F.col("n")))
    out = out.unionByName(row(by_camera.filter("clips <= 2"), "few_clips", F.col("camera"), F.col("clips")))
    night = base.filter("day_night = 'night'").groupBy("site").agg(F.count_distinct("clip").alias("n"))
    out = out.unionByName(row(night, "night_clips", F.col("site"), F.col("n")))
    buses = base.groupBy("site").agg(F.sum("bus").alias("bus")).filter("bus > 0")
    top = buses.orderBy(F.desc("bus"), "site").limit(3)
    whole = buses.agg(F.sum("bus").alias("all_buses"))  # a single row
    out = out.unionByName(row(top, "bus_sites", F.col("site"), F.col("bus")))
    out = out.unionByName(row(top.agg(F.sum("bus").alias("bus")).crossJoin(F.broadcast(whole)), "bus_sites", F.lit("(share)"), of(F.col("bus"), F.col("all_buses"))))
    kinds = base.filter("hour_type in ('NH', 'RH')").groupBy("camera", "hour_type").agg(of(objects, total).alias("m"))
    both = kinds.groupBy("camera").pivot("hour_type", ["NH", "RH"]).agg(F.first("m")).filter("NH is not null and RH is not null")
    pairs = both.agg(F.count("*").alias("both"), F.count_if(F.col("RH") > F.col("NH")).alias("more"))
    out = out.unionByName(row(pairs, "paired_hours", F.lit("cameras_with_both"), F.col("both"))).unionByName(row(pairs, "paired_hours", F.lit("cameras_more_in_rush"), F.col("more")))
    light = rows.filter("brightness is not null and day_night <> ''").groupBy("day_night").agg(F.percentile("brightness", 0.5).alias("m"))
    out = out.unionByName(row(light, "brightness", F.col("day_night"), F.col("m")))
    small = polygons.groupingSets([["cls"], []], "cls").agg(F.grouping("cls").alias("g"), F.avg((F.col("area_train_px") < SMALL_PX).cast("int")).alias("s"))
    return out.unionByName(row(small, "small_objects", F.when(F.col("g") == 1, "(all)").otherwise(F.col("cls")), F.col("s")))
