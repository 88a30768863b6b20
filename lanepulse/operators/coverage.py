"""How much of an image its polygons cover: scan conversion into runs, and their union by a sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _crossings(points: Column, y: Column) -> Column:
    """Where a polygon's edges cross the height ``y``, from left to right."""
    turned = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    edges = F.filter(F.arrays_zip(points.alias("p"), turned.alias("q")), lambda e: (e["p"]["y"] <= y) != (e["q"]["y"] <= y))
    along = lambda e: e["p"]["x"] + (y - e["p"]["y"]) * (e["q"]["x"] - e["p"]["x"]) / (e["q"]["y"] - e["p"]["y"])
    return F.array_sort(F.transform(edges, along))


def polygon_runs(polygons: DataFrame, scale: float = 0.25) -> DataFrame:
    """(image_id, y, x0, x1): the runs of pixels whose centres lie inside each polygon, by the even-odd rule.

    ``polygons`` has image_id, points (shares of the image, an array of structs x, y), width and height; pixels are those of the image
    at ``scale``, one at least. Runs end before x1 and are cut to the image; polygons of fewer than three points, or null, have none."""
    size = lambda c: F.greatest(F.lit(1), F.round(F.col(c) * scale)).cast("int")
    rows = polygons.filter("size(points) > 2").select("image_id", "points", size("width").alias("mw"), size("height").alias("mh"))
    moved = F.transform("points", lambda p: F.struct((p["x"] * F.col("mw")).alias("x"), (p["y"] * F.col("mh")).alias("y")))
    rows = rows.withColumn("points", moved)
    top, bottom = F.array_min(F.transform("points", lambda p: p["y"])), F.array_max(F.transform("points", lambda p: p["y"]))
    # rows whose centre a polygon can reach
    first, last = F.greatest(F.lit(0), F.ceil(top - 0.5)).cast("int"), F.least(F.col("mh") - 1, F.floor(bottom - 0.5)).cast("int")
    rows = rows.withColumns({"first": first, "last": last}).filter("first <= last").withColumn("y", F.explode(F.sequence("first", "last")))
    rows = rows.withColumn("at", _crossings(F.col("points"), F.col("y") + 0.5)).filter("size(at) > 1").select("image_id", "y", "mw", "at")
    rows = rows.select("image_id", "y", "mw", "at", F.explode(F.sequence(F.lit(0), (F.size("at") / 2).cast("int") - 1)).alias("k"))
    pixel = lambda i: F.greatest(F.lit(0), F.least(F.col("mw"), F.ceil(F.get("at", i) - 0.5).cast("int")))
    return rows.select("image_id", "y", pixel(F.col("k") * 2).alias("x0"), pixel(F.col("k") * 2 + 1).alias("x1")).filter("x0 < x1")


def coverage(images: DataFrame, polygons: DataFrame, scale: float = 0.25) -> DataFrame:
    """Per image (image_id, width, height): the share of pixels that polygons cover (``vehicle_area_ratio``), the sum of what each
    covers (``vehicle_area_sum``), and the share of the sum that lies on another (``overlap_ratio``, 0 without any).

    Runs begin and end; between two neighbouring ends in a row of pixels the number of open runs is the
    number of polygons there. Only ends are sorted, by image and row; no pixel becomes a row."""
    runs = polygon_runs(polygons, scale)
    ends = runs.select("image_id", "y", F.inline(F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("step")), F.struct(F.col("x1").alias("x"), F.lit(-1).alias("step")))))
    ends = ends.groupBy("image_id", "y", "x").agg(F.sum("step").alias("step"))
    w = W.partitionBy("image_id", "y").orderBy("x")
    open_ = ends.select("image_id", (F.lead("x").over(w) - F.col("x")).alias("n"), F.sum("step").over(w).alias("depth"))
    sums = open_.filter("depth > 0").groupBy("image_id").agg(F.sum("n").alias("union_px"), F.sum(F.col("n") * F.col("depth")).alias("sum_px"))
    size = lambda c: F.greatest(F.lit(1), F.round(F.col(c) * scale)).cast("long")
    out = images.select("image_id", (size("width") * size("height")).alias("px")).join(sums, "image_id", "left")
    union, total = F.coalesce("union_px", F.lit(0)), F.coalesce("sum_px", F.lit(0))
    return out.select("image_id", (union / F.col("px")).alias("vehicle_area_ratio"), (total / F.col("px")).alias("vehicle_area_sum"), F.when(total > 0, 1 - union / total).otherwise(0.0).alias("overlap_ratio"))
