"""Queries of the readers and writers: rows of the given tables are written in each format and read back."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ..functions.text import match_key
from ..operators import manifest as N
from ..sources import files as S
from .models import cameras, directions, members, read, samples, with_sql

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


@query("s3_manifest", "SELECT CAST(o_orderkey AS VARCHAR) AS image_id, o_orderpriority AS clip, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS note FROM orders")
def s3(spark, d):
    path = S.work_folder(spark, "manifest")
    S.write_csv(read(spark, d, "orders").selectExpr("o_orderkey AS image_id", "o_orderpriority AS clip", "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS note"), path)
    return S.read_manifest(spark, path)


@query("s4_read_labels", """SELECT CAST(l_suppkey AS VARCHAR) AS image_id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS INT) AS line_no,
  concat(l_partkey % 3, ' ', l_partkey, ' ', l_orderkey) AS line FROM lineitem""")
def s4(spark, d):
    path = S.work_folder(spark, "labels")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
    S.write_labels(read(spark, d, "lineitem").selectExpr("l_suppkey AS image_id", *order, "concat(l_partkey % 3, ' ', l_partkey, '  ', l_orderkey) AS value"), path, order)
    got = S.read_labels(spark, path)
    return got.select("image_id", "line_no", F.array_join("tokens", " ").alias("line"))


_XML = """WITH f AS (SELECT p_partkey AS k, concat('f', p_partkey, '.jpg') AS image_name, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 64 END AS width, p_size FROM part WHERE p_partkey % 7 > 0)"""


@query("s5_frames_xml", _XML + """ SELECT image_name, width, 36 AS height, CASE WHEN k % 5 = 0 THEN 0 ELSE 1 END AS polygons, CASE WHEN k % 5 = 0 THEN NULL ELSE 'car' END AS label,
  CASE WHEN k % 5 = 0 THEN NULL ELSE p_size + 2.5::DOUBLE END AS last_x, CASE WHEN k % 5 = 0 THEN NULL ELSE 3 END AS points FROM f""")
def s5(spark, d):
    """Frames without a name drop out; a missing width is 0."""
    path = S.work_folder(spark, "frames")
    part = read(spark, d, "part")
    polygon = F.array(F.struct(F.lit("car").alias("_label"), F.concat(F.lit("0,0;4,1;"), F.col("p_size") + 2.5, F.lit(",3")).alias("_points")))
    rows = part.select(
        F.when(F.col("p_partkey") % 7 > 0, F.concat(F.lit("f"), "p_partkey", F.lit(".jpg"))).alias("_name"), F.when(F.col("p_partkey") % 4 > 0, 64).alias("_width"),
        F.lit(36).alias("_height"), F.when(F.col("p_partkey") % 5 > 0, polygon).alias("polygon"),
    )
    rows.write.format("xml").option("rowTag", "image").option("rootTag", "annotations").save(path)
    got = S.read_frames_xml(spark, path)
    first = F.get("polygons", F.lit(0))
    return got.select(
        "image_name", "width", "height", F.size("polygons").alias("polygons"), first["label"].alias("label"),
        F.element_at(first["points"], -1)["x"].alias("last_x"), F.when(F.size("polygons") > 0, F.size(first["points"])).alias("points"),
    )


_CATALOGUE = """WITH s AS (SELECT s_suppkey AS id, s_name AS name, s_suppkey // 10 AS block, row_number() OVER (PARTITION BY s_suppkey // 10 ORDER BY s_suppkey) AS r FROM supplier)"""


@query("s6_s7_catalogue", _CATALOGUE + """ SELECT CASE WHEN block % 2 = 0 THEN 'ex' ELSE 'its' END AS road_type, name, 127.0::DOUBLE + id % 100 AS lon, 36.5::DOUBLE AS lat FROM s
  WHERE block % 5 < 4 AND id % 11 > 0 AND (block % 5 <> 1 OR r = 1)""")
def s67(spark, d):
    """Responses of ten items each: JSON lists, lone objects, XML and errors, of both road types."""
    rows = read(spark, d, "supplier").selectExpr("s_suppkey AS id", "s_suppkey div 10 AS block", "s_name AS cctvname", "CASE WHEN s_suppkey % 11 = 0 THEN 'bad' ELSE CAST(127D + s_suppkey % 100 AS STRING) END AS coordx", "'36.5' AS coordy")
    item = F.struct("id", "cctvname", "coordx", "coordy")
    rows = rows.groupBy("block").agg(F.array_sort(F.collect_list(item)).alias("items"))  # at most ten rows a block
    tag = lambda n, v: F.concat(F.lit(f"<{n}>"), v, F.lit(f"</{n}>"))
    xml = F.transform("items", lambda i: tag("data", F.concat(*(tag(c, i[c]) for c in ("cctvname", "coordx", "coordy")))))
    listed = F.to_json(F.struct(F.struct(F.lit("0").alias("resultCode"), F.col("items").alias("data")).alias("response")))
    lone = F.to_json(F.struct(F.struct(F.get("items", F.lit(0)).alias("data")).alias("response")))
    kind = F.col("block") % 5
    body = F.when(kind == 4, F.lit('{"response": {"resultCode": "4005", "resultMsg": "no"}}')).when(kind == 1, lone)
    body = body.when(kind == 2, tag("response", F.concat(tag("resultCode", F.lit("0")), F.array_join(xml, "")))).otherwise(listed)
    rows = rows.select(F.when(F.col("block") % 2 == 0, "ex").otherwise("its").alias("road_type"), body.alias("body"))
    parts = [S.parse_catalogue(rows.filter(F.col("road_type") == t)) for t in ("ex", "its")]
    return S.union_catalogues(parts).select("road_type", "name", "lon", "lat")


@query("s8_captures", """SELECT camera_id, t, occupancy, CASE WHEN occupancy IS NULL THEN NULL ELSE n END AS nv FROM (SELECT user_id AS camera_id, epoch_us(ts) AS t,
    CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS occupancy, event_id % 7 + 2.0::DOUBLE AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events) WHERE r <= 3""")
def s8(spark, d):
    """The newest three documents a camera; every ninth line beside them is cut short."""
    path = S.work_folder(spark, "captures")
    metric = lambda i, o: F.struct(F.lit(i).alias("direction_index"), o.alias("occupancy"), (F.col("event_id") % 7).cast("double").alias("n_car"), F.lit(2.0).alias("n_bus"), F.lit(0.0).alias("n_truck"))
    whole, other = metric(0, F.col("value")), metric(1, F.lit(0.5))
    dirs = F.when(F.col("event_id") % 4 == 0, F.array(other)).otherwise(F.array(other, whole))
    ts = F.concat(F.col("ts").cast("timestamp_ntz").cast("string"), F.lit("Z"))
    doc = F.to_json(F.struct(F.col("user_id").alias("camera_id"), ts.alias("ts"), F.struct(dirs.alias("directions")).alias("live")))
    lines = F.when(F.col("event_id") % 9 == 0, F.array(doc, F.substring(doc, 1, 30))).otherwise(F.array(doc))
    read(spark, d, "events").select(F.explode(lines).alias("value")).write.text(path)
    return S.read_captures(spark, path, 3).select("camera_id", F.unix_micros("ts").alias("t"), "occupancy", "nv")


@query("s9_read_logs", """SELECT CAST(o_orderkey AS VARCHAR) AS run, o_orderpriority AS loss, NULL::VARCHAR AS map FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), NULL, o_orderpriority FROM orders WHERE o_orderstatus <> 'F'""")
def s9(spark, d):
    path, o = S.work_folder(spark, "logs"), read(spark, d, "orders")
    o.filter("o_orderstatus = 'F'").selectExpr("o_orderkey AS run", "o_orderpriority AS loss").write.option("header", True).csv(f"{path}/a")
    o.filter("o_orderstatus <> 'F'").selectExpr("o_orderpriority AS map", "o_orderkey AS run").write.option("header", True).csv(f"{path}/b")
    return S.read_logs(spark, [f"{path}/a", f"{path}/b"])


@query("s11_append_samples", with_sql("samples") + " SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, round(sum(occupancy), 6) AS occupancy FROM samples GROUP BY 1")
def s11(spark, d):
    path = S.work_folder(spark, "samples")
    for rest in (0, 1):
        S.append_samples(samples(spark, d).filter(f"event_id % 2 = {rest}"), path)
    rows = spark.read.parquet(path)
    return rows.groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("occupancy"), 6).alias("occupancy"))


@query("s11_append_stream", with_sql("samples") + " SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, round(sum(occupancy), 6) AS occupancy FROM samples GROUP BY 1")
def s11s(spark, d):
    """A stream over the samples in four files: stopped by a failure after its second batch was written, and started again."""
    path, rows = S.work_folder(spark, "stream"), samples(spark, d).select("event_id", "camera_id", "occupancy", F.expr("timestamp_micros(CAST(t * 1000000 AS BIGINT))").alias("ts"))
    for part in range(4):
        rows.filter(f"event_id % 4 = {part}").coalesce(1).write.mode("append").parquet(f"{path}/in")

    def stream(frame):
        return frame.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")

    def fail(number):
        raise RuntimeError(f"lost after batch {number}")

    broken = stream(spark).writeStream.option("checkpointLocation", f"{path}/check").trigger(availableNow=True)
    write = lambda batch, number: (batch.withColumn("day", F.to_date("ts")).write.mode("overwrite").partitionBy("day").parquet(f"{path}/out/batch={number}"), number and fail(number))
    try:
        broken.foreachBatch(write).start().awaitTermination()
    except StreamingQueryException:
        pass
    S.append_stream(stream(spark), f"{path}/out", f"{path}/check").awaitTermination()
    out = S.read_appended(spark, f"{path}/out")
    return out.groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("occupancy"), 6).alias("occupancy"))


_REPLACED = """, f AS (SELECT event_id, camera_id, occupancy FROM samples WHERE source = 'file')
  SELECT event_id, camera_id, occupancy FROM f WHERE camera_id % 2 = 1 UNION ALL SELECT event_id, camera_id, 0.5::DOUBLE FROM f WHERE camera_id % 2 = 0 AND camera_id % 3 > 0 AND event_id % 2 = 0"""


@query("s12_replace_samples", with_sql("samples") + _REPLACED)
def s12(spark, d):
    """Even cameras are analysed again: some with half their samples, every third without any."""
    path = S.work_folder(spark, "replace")
    rows = samples(spark, d).filter("source = 'file'").select("event_id", "camera_id", "occupancy")
    S.replace_file_samples(rows, path)
    again = rows.filter("camera_id % 2 = 0 AND camera_id % 3 > 0 AND event_id % 2 = 0").withColumn("occupancy", F.lit(0.5))
    S.replace_file_samples(again, path, rows.filter("camera_id % 2 = 0").select("camera_id"))
    return S.read_file_samples(spark, path)


@query("s12_replace_live", with_sql("samples") + """, f AS (SELECT event_id, camera_id, occupancy, CAST(ts AS DATE) AS day FROM samples)
  SELECT event_id, camera_id, occupancy, CAST(day AS VARCHAR) AS day FROM f WHERE camera_id % 2 = 1 UNION ALL SELECT event_id, camera_id, 0.5::DOUBLE, CAST(day AS VARCHAR) FROM f WHERE camera_id % 2 = 0 AND event_id % 2 = 0 AND day < DATE '2024-01-10'""")
def s12l(spark, d):
    path = S.work_folder(spark, "live")
    rows = samples(spark, d).select("event_id", "camera_id", "occupancy", F.expr("timestamp_micros(CAST(t * 1000000 AS BIGINT))").alias("ts"))
    S.append_samples(rows, path)
    even = rows.filter("camera_id % 2 = 0")
    S.replace_live_samples(even.filter("event_id % 2 = 0 and ts < timestamp'2024-01-10'").withColumn("occupancy", F.lit(0.5)), path, even.select("camera_id"))
    return spark.read.parquet(path).select("event_id", "camera_id", "occupancy", F.col("day").cast("string").alias("day"))


@query("s12_delete_samples", with_sql("samples") + " SELECT event_id, camera_id, source FROM samples WHERE NOT (camera_id % 10 = 3 OR (camera_id % 10 = 4 AND source = 'file'))")
def s12d(spark, d):
    rows, ids = samples(spark, d).select("event_id", "camera_id", "source"), cameras(spark, d).selectExpr("id AS camera_id").union(samples(spark, d).select("camera_id"))
    return S.delete_samples(S.delete_samples(rows, ids.filter("camera_id % 10 = 3")), ids.filter("camera_id % 10 = 4"), "file")


@query("s13_backfill", with_sql("cameras") + " SELECT id, CASE WHEN id % 3 = 0 THEN 5.0::DOUBLE ELSE id % 7 + 1.0::DOUBLE END AS infer_interval_s FROM cameras")
def s13(spark, d):
    rows = cameras(spark, d).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 7 + 1.0).alias("infer_interval_s"))
    return S.backfill_interval(rows, 5.0)


@query("s16_group_table", with_sql("cameras", "directions", "members") + """ SELECT group_id, label, max(heading_deg) FILTER (index = 1) AS "D1", max(heading_deg) FILTER (index = 2) AS "D2"
  FROM members m JOIN directions d ON m.camera_id = d.camera_id GROUP BY ALL""")
def s16(spark, d):
    rows = members(spark, d).join(directions(spark, d).selectExpr("camera_id", "name AS direction_name", "heading_deg AS occupancy"), "camera_id")
    return S.group_table(rows, ["D1", "D2"])


@query("s17_manifest", """SELECT CAST(o_orderkey AS VARCHAR) AS image_id, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE '' END AS clip, CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus END AS note FROM orders""")
def s17(spark, d):
    path, o = S.work_folder(spark, "union"), read(spark, d, "orders")
    a = o.filter("o_orderstatus = 'F'").selectExpr("CAST(o_orderkey AS STRING) AS image_id", "o_orderpriority AS clip")
    b = o.filter("o_orderstatus <> 'F'").selectExpr("CAST(o_orderkey AS STRING) AS image_id", "o_orderstatus AS note")
    S.write_manifest([a, b], path)
    return S.read_manifest(spark, path)


@query("s17_report", "SELECT o_orderkey AS id, o_orderpriority AS priority, o_totalprice AS price FROM orders")
def s17r(spark, d):
    path = S.work_folder(spark, "report")
    S.write_report(read(spark, d, "orders").selectExpr("o_orderkey AS id", "o_orderpriority AS priority", "o_totalprice AS price"), path)
    return spark.read.text(path).select(F.from_json("value", "id long, priority string, price double").alias("r")).select("r.*")


@query("t1_match_key", r"""SELECT p_partkey, lower(regexp_replace(trim(regexp_replace(regexp_replace(n, '^.*[/\\]', ''), '\.[^.]*$', '')), '\s+', '_', 'g')) AS key
  FROM (SELECT p_partkey, nfc_normalize(CASE p_partkey % 4 WHEN 0 THEN 'clips/Frame ' WHEN 1 THEN 'clips\\day 1\\Frame ' WHEN 2 THEN 'é' || chr(47) || 'Suwo' || chr(110) || 'é ' ELSE 'x/Suwone' || chr(769) || ' ' END || p_partkey || '  A.JPG') AS n FROM part)""")
def t1(spark, d):
    """Names with either slash, and with composed and decomposed letters, whose keys are alike."""
    k = F.col("p_partkey") % 4
    front = F.when(k == 0, "clips/Frame ").when(k == 1, "clips\\day 1\\Frame ").when(k == 2, "é/Suwoné ").otherwise("x/Suwone\u0301 ")
    name = F.concat(front, F.col("p_partkey").cast("string"), F.lit("  A.JPG"))
    return read(spark, d, "part").select("p_partkey", match_key(name).alias("key"))


@query("t13_check_size", """SELECT p_partkey, abs(w / h - 16 / 9::DOUBLE) / (16 / 9::DOUBLE) <= 0.01 AS same_shape, w <> 1920 OR h <> 1080 AS scaled
  FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 1920 WHEN 1 THEN 1280 WHEN 2 THEN 1925 ELSE 1600 END::DOUBLE AS w, CASE p_partkey % 4 WHEN 1 THEN 720 ELSE 1080 END::DOUBLE AS h FROM part)""")
def t13(spark, d):
    k = F.col("p_partkey") % 4
    w = F.when(k == 0, 1920).when(k == 1, 1280).when(k == 2, 1925).otherwise(1600)
    same, scaled = N.check_size(w, F.when(k == 1, 720).otherwise(1080), F.lit(1920), F.lit(1080))
    return read(spark, d, "part").select("p_partkey", same.alias("same_shape"), scaled.alias("scaled"))


@query("t15_stale_files", "SELECT DISTINCT l_orderkey AS image_id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def t15(spark, d):
    present = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id")).distinct()
    return N.stale_files(present, read(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("image_id")))
