"""Readers and writers on small files, and the streaming operators."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lanepulse.operators.routes import chain_points, spread_points
from lanepulse.sources import files as S
from lanepulse.streaming import samples as W


def test_manifest_keeps_strings(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿id,time\n1,0956\n2,\n", encoding="utf-8")
    rows = S.read_manifest(spark, str(tmp_path / "m.csv")).orderBy("id").collect()
    assert [(r.id, r.time) for r in rows] == [("1", "0956"), ("2", "")]


def test_labels_and_xml(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 0.1 0.2\n\n1 0.3 0.4\n")
    rows = S.read_labels(spark, str(tmp_path / "a.txt")).orderBy("line_no").collect()
    assert [(r.image_id, r.line_no, r.tokens[0]) for r in rows] == [("a", 1, "0"), ("a", 3, "1")]
    (tmp_path / "f.xml").write_text('<annotations><image name="x.jpg" width="4" height="2"><polygon label="car" points="0,0;1,0;1,1"/></image><image width="3"/></annotations>')
    (row,) = S.read_frames_xml(spark, str(tmp_path / "f.xml")).collect()
    assert row.image_name == "x.jpg" and row.width == 4 and len(row.polygons[0].points) == 3


def test_catalogue(spark):
    item = {"cctvname": "n", "coordx": "127.1", "coordy": "37.5", "cctvurl": "u"}
    bodies = [
        ("a", json.dumps({"response": {"data": [item, item | {"coordx": "bad"}]}})),
        ("b", json.dumps({"response": {"data": item}})),
        ("c", json.dumps({"response": {"resultCode": "4005", "resultMsg": "no"}})),
        ("d", "<response><data><cctvname>x</cctvname><coordx>1</coordx><coordy>2</coordy></data></response>"),
    ]
    items, errors = S.parse_catalogue(spark.createDataFrame(bodies, "road_type string, body string"))
    assert sorted(r.road_type for r in items.collect()) == ["a", "b", "d"]
    assert [(r.road_type, r.code) for r in errors.collect()] == [("c", "4005")]


def test_captures_logs_and_replacement(spark, tmp_path):
    doc = {"camera_id": 1, "ts": "2024-01-01T00:00:00", "live": {"directions": [{"direction_index": 0, "occupancy": 0.2, "n_car": 1, "n_bus": 0, "n_truck": 1}]}}
    (tmp_path / "c.json").write_text(json.dumps(doc) + "\n{broken\n")
    (row,) = S.read_captures(spark, str(tmp_path / "c.json")).collect()
    assert row.occupancy == 0.2 and row.nv == 2
    (tmp_path / "l1.csv").write_text("run,a\n1,2\n")
    (tmp_path / "l2.csv").write_text("run,b\n2,3\n")
    assert S.read_logs(spark, [str(tmp_path / "l1.csv"), str(tmp_path / "l2.csv")]).columns == ["run", "a", "b"]


def test_replacement_by_keys(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "samples"), "camera_id int, o double"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    now = lambda: sorted((r.camera_id, r.o) for r in S.read_file_samples(spark, path).collect())
    S.replace_file_samples(rows((1, 0.1), (2, 0.2), (3, 0.3)), path)
    S.replace_file_samples(rows((1, 0.9)), path)
    assert now() == [(1, 0.9), (2, 0.2), (3, 0.3)]
    S.replace_file_samples(rows((4, 0.4)), path, rows((2, 0.0), (4, 0.0)))  # camera 2 has no new samples
    assert now() == [(1, 0.9), (3, 0.3), (4, 0.4)]
    with pytest.raises(ValueError, match="not replaced"):
        S.replace_file_samples(rows((5, 0.5)), path, rows((1, 0.0)))
    # a failure half way leaves the old state
    broken = rows((1, 0.0), (3, 0.0)).withColumn("o", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        S.replace_file_samples(broken, path)
    assert now() == [(1, 0.9), (3, 0.3), (4, 0.4)]
    S.replace_file_samples(rows(), path, rows((1, 0.0), (3, 0.0), (4, 0.0)))
    assert now() == []


def test_chains():
    """A run whose middle is the nearest point after a gap is walked from its far end."""
    east = [(36.0, 127.0 + i * 0.02) for i in range(40)]
    north = [(36.4 + abs(i) * 0.001, 127.0 + i * 0.02) for i in range(-20, 21)]
    chains = chain_points(spread_points(east[1::3] + north + east[::3] + east[2::3] + [(36.0001, 127.0)]))
    assert len(chains) == 2 and sorted(len(c) for c in chains) == [40, 41]
    for chain, line in zip(sorted(chains, key=len), (east, north), strict=True):
        assert chain in (line, line[::-1])
    assert chain_points([]) == [] and spread_points([(1.0, 2.0), (1.0, 2.0)]) == [(1.0, 2.0)]


def frames(spark):
    rows = [(1, 0, i, pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=i), 0.3 if i < 60 else 0.01) for i in range(70)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["camera_id", "direction_index", "seq", "ts", "occupancy"]))
    return df.select("*", *[F.lit(1.0).alias(c) for c in W.MEANS if c != "occupancy"])


def test_sample_windows_batch_equals_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    frames(spark).union(frames(spark)).write.parquet(src)
    want = sorted(map(tuple, W.sample_windows(spark.read.parquet(src)).collect()))
    assert len(want) == 14 and want[0][-1] == 5
    stream = W.sample_windows(spark.readStream.schema(spark.read.parquet(src).schema).parquet(src))
    q = stream.writeStream.format("memory").queryName("windows").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.sql("select * from windows").collect()))
    # the watermark ends a minute before the last frame: windows up to it are out, once each
    assert got == [w for w in want if w[0] + pd.Timedelta(seconds=5) <= pd.Timestamp("2024-01-01 00:00:09")] and len(got) == 1


def test_stride_rate_and_video(spark):
    f = frames(spark).withColumn("t", F.col("seq").cast("double")).withColumn("source_fps", F.lit(30.0)).withColumn("idx", F.col("seq"))
    assert [r.seq for r in W.stride_sample(f, 2.0).orderBy("seq").collect()] == [14, 29, 44, 59]
    gap = f.withColumn("t", F.col("t") + F.when(F.col("seq") >= 20, 100.0).otherwise(0.0))
    assert [r.seq for r in W.stride_sample(gap, 2.0, 50.0).orderBy("seq").collect()] == [14, 34, 49, 64]
    assert [r.t for r in W.rate_limit(f, 2.5).orderBy("t").limit(3).collect()] == [0.0, 3.0, 6.0]
    assert W.inference_rate(f).filter("fps = 1").count() == 69
    assert W.video_samples(f, 10.0).count() == 7
    (s,) = W.video_summary(f, 10.0).collect()
    assert s.duration_s == 6.9 and s.processed == 70 and s.max == 0.3


def test_episode_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    frames(spark).select("camera_id", "direction_index", "ts", "occupancy").write.parquet(src)
    rows = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src).withWatermark("ts", "1 second")
    q = W.episode_stream(rows, 0.25, 20, 30).writeStream.format("memory").queryName("episodes").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    (row,) = spark.sql("select * from episodes").collect()
    assert row.samples == 60 and row.peak == 0.3 and row.start_ts == pd.Timestamp("2024-01-01")


def test_episode_stream_in_another_zone(spark, tmp_path):
    """An episode that stays open is ended by the watermark alone, whatever the session's zone."""
    src, at = str(tmp_path / "in"), lambda c: F.timestamp_seconds(F.lit(1704067200) + c)
    rows = spark.range(60).select(F.lit(1).cast("long").alias("camera_id"), F.lit(0).alias("direction_index"), at(F.col("id")).alias("ts"), F.lit(0.3).alias("occupancy"))
    other = spark.range(1).select(F.lit(2).cast("long"), F.lit(0), at(F.lit(100)), F.lit(0.0)).toDF(*rows.columns)
    rows.coalesce(1).write.mode("append").parquet(src)
    other.write.mode("append").parquet(src)
    for zone in ("UTC", "Asia/Seoul", "America/New_York"):
        session = spark.newSession()
        session.conf.set("spark.sql.session.timeZone", zone)
        stream = session.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src).withWatermark("ts", "1 second")
        out = str(tmp_path / zone.replace("/", "-"))
        q = W.episode_stream(stream, 0.25, 20, 30).writeStream.format("parquet").option("checkpointLocation", f"{out}-check").trigger(availableNow=True).start(out)
        q.awaitTermination()
        (row,) = session.read.parquet(out).select(F.unix_seconds("start_ts").alias("a"), F.unix_seconds("end_ts").alias("b"), "samples").collect()
        assert tuple(row) == (1704067200, 1704067259, 60), zone


def test_open_episodes_are_held_by_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "BUCKETS", 8)
    path, schema = str(tmp_path / "in"), "camera_id long, direction_index int, ts timestamp, occupancy double"
    rows = spark.range(900).selectExpr("nullif(id % 300, 7) AS camera_id", "0 AS direction_index", "timestamp_seconds(1000 + id DIV 300 * 20) AS ts", "IF(id % 300 < 200, 0.5D, 0.1D) AS occupancy")
    rows.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(schema).parquet(path).withWatermark("ts", "1 second")
    q = W.episode_stream(stream, 0.25, 20, 30).writeStream.format("memory").queryName("buckets").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 8
    # one later sample closes them all
    rows.limit(1).selectExpr("-1L AS camera_id", "0 AS direction_index", "timestamp_seconds(9000) AS ts", "0.5D AS occupancy").write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).parquet(path).withWatermark("ts", "1 second")
    q = W.episode_stream(stream, 0.25, 20, 30).writeStream.format("memory").queryName("buckets2").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("buckets2").collect()
    assert len(got) == 200 and {r.camera_id for r in got} == {None if c == 7 else c for c in range(200)} and {r.samples for r in got} == {3}


def test_label_files_in_one_folder(spark, tmp_path):
    """A file for each image, none beside them, lines in order over batches and tasks; images share no folder of their own."""
    path = f"file://{tmp_path}/labels"
    rows = spark.range(30_000).selectExpr("id % 7 AS image_id", "CAST(id AS INT) AS at", "concat(id % 3, '  ', id, ' é') AS value")
    S.write_labels(rows.orderBy(F.desc("at")), path, ["at"])
    assert sorted(p.name for p in (tmp_path / "labels").iterdir()) == [f"{k}.txt" for k in range(7)]
    got = S.read_labels(spark, path).filter("image_id in ('0', '3')").orderBy("image_id", "line_no").collect()
    assert [(r.image_id, r.line_no, r.tokens) for r in got] == [(str(k), n + 1, [str(i % 3), str(i), "é"]) for k in (0, 3) for n, i in enumerate(range(k, 30_000, 7))]
    with pytest.raises(Exception, match="not a file's name"):
        S.write_labels(rows.selectExpr("'a/b' AS image_id", "at", "value"), path, ["at"])
