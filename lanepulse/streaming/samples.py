"""From frames to samples: windowed averages, latest states, strides, rates, episodes.

The aggregations are one code for batch and streams; those that depend on each kept row in
turn use grouped state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Groups of cameras whose open episodes are one state.
BUCKETS = 1024
MEANS = ("occupancy", "vehicle_px", "road_px", "n_car", "n_bus", "n_truck")


def sample_windows(frames: DataFrame, seconds: int = 5, late: str = "1 minute") -> DataFrame:
    """Tumbling averages per camera and direction with the number of frames; append mode as a stream.

    ``frames`` has ts; repeated frames of a camera (by ``seq``) count once if it has that column."""
    if frames.isStreaming:
        frames = frames.withWatermark("ts", late)
        if "seq" in frames.columns:
            frames = frames.dropDuplicatesWithinWatermark(["camera_id", "direction_index", "seq"])
    elif "seq" in frames.columns:
        frames = frames.dropDuplicates(["camera_id", "direction_index", "seq"])
    grouped = frames.groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "camera_id", "direction_index")
    out = grouped.agg(*(F.avg(c).alias(c) for c in MEANS), F.count("*").alias("n_frames"))
    return out.select(F.col("w.start").alias("ts"), "camera_id", "direction_index", *MEANS, "n_frames")


def per_frame(frames: DataFrame) -> DataFrame:
    """Every frame as its own sample."""
    return frames.select("ts", "camera_id", "direction_index", *MEANS, F.lit(1).cast("long").alias("n_frames"))


def latest(frames: DataFrame) -> DataFrame:
    """The newest state per camera and direction (update mode as a stream)."""
    return frames.groupBy("camera_id", "direction_index").agg(F.max_by(F.struct("ts", "occupancy"), "ts").alias("s")).select("camera_id", "direction_index", "s.ts", "s.occupancy")


def stride(source_fps: Column, infer_fps: float) -> Column:
    """Every how many frames one is processed; an unlikely frame rate counts as 15."""
    fps = F.when(source_fps.between(1, 120), source_fps).otherwise(15.0)
    return F.greatest(F.lit(1), F.round(fps / infer_fps).cast("int"))


def stride_sample(frames: DataFrame, infer_fps: float, idle_s: float | None = None) -> DataFrame:
    """Every n-th frame of each camera (by :func:`stride` of the frame's rate), counted from the first.

    After more than ``idle_s`` seconds without a frame the count starts anew. Frames without a camera count
    as one camera's. A stream (with a watermark on ts; columns camera_id, ts, t, seq, source_fps) gives the same frames
    as a batch, if they come in order: its state is a camera's count, dropped once the watermark
    is past the idle time. Streams need the RocksDB state store."""
    if frames.isStreaming:
        rows = frames.select("camera_id", "ts", "t", "seq", "source_fps", stride(F.col("source_fps"), infer_fps).alias("every"))
        return _stateful(rows, Stride(idle_s), frames.select("camera_id", "t", "seq", "source_fps").schema)
    w = W.partitionBy("camera_id").orderBy("t", "seq")
    if idle_s is None:
        rows, keys = frames, ["camera_id"]
    else:
        new = F.coalesce((F.col("t") - F.lag("t").over(w) > idle_s).cast("int"), F.lit(0))
        rows = frames.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w)).drop("_new")
        keys = ["camera_id", "_run"]
    n = F.row_number().over(W.partitionBy(*keys).orderBy("t", "seq"))
    return rows.withColumn("n", n).filter(F.col("n") % stride(F.col("source_fps"), infer_fps) == 0).drop("n", "_run")


def _stateful(rows: DataFrame, processor: StatefulProcessor, schema) -> DataFrame:
    # a key of its own: pandas leaves out groups whose key is null
    rows = rows.withColumn("_key", F.coalesce(F.col("camera_id").cast("string"), F.lit("")))
    return rows.groupBy("_key").transformWithStateInPandas(processor, schema, "append", "EventTime")


class _PerCamera(StatefulProcessor):
    """Decides on each frame of a camera in turn, with a state of two numbers that a timer drops."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "a double, b double")

    def take(self, state: tuple | None, row) -> tuple[tuple | None, bool]:
        raise NotImplementedError

    def until(self, state: tuple) -> float | None:
        """The time from which the state makes no difference."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["t", "seq"], kind="stable")
        state = tuple(self.held.get()) if self.held.exists() else None
        keep = []
        for row in frame.itertuples():
            state, ok = self.take(state, row)
            keep.append(ok)
        self.settle(state, timerValues)
        columns = [c for c in frame.columns if c not in ("_key", "ts", "every")]
        yield frame.loc[keep, columns]

    def settle(self, state: tuple | None, timerValues) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if state is not None:
            self.held.update(state)
            end = self.until(state)
            if end is not None:
                self.handle.registerTimer(max(int(end * 1000) + 1, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


class Stride(_PerCamera):
    """State: frames counted, and the time of the last."""

    def __init__(self, idle_s: float | None):
        self.idle_s = idle_s

    def take(self, state, row):
        n = 0 if state is None or (self.idle_s is not None and row.t - state[1] > self.idle_s) else int(state[0])
        return (float(n + 1), float(row.t)), (n + 1) % int(row.every) == 0

    def until(self, state):
        return None if self.idle_s is None else state[1] + self.idle_s


class RateLimit(_PerCamera):
    """State: the time of the last kept frame (twice)."""

    def __init__(self, least_s: float):
        self.least_s = least_s

    def take(self, state, row):
        ok = state is None or row.t - state[0] >= self.least_s
        return ((float(row.t), float(row.t)) if ok else state), ok

    def until(self, state):
        return state[0] + self.least_s


def inference_rate(frames: DataFrame) -> DataFrame:
    """Frames a second since the frame before, 0 for the first."""
    w = W.partitionBy("camera_id").orderBy("t", "seq")
    gap = F.col("t") - F.lag("t").over(w)
    return frames.withColumn("fps", F.coalesce(F.when(gap > 0, 1 / gap), F.lit(0.0)))


def rate_limit(frames: DataFrame, least_s: float) -> DataFrame:
    """Frames at least so many seconds after the last kept one of their camera.

    Whether a frame is kept depends on those kept before: a fold over each camera's frames,
    here over sorted partitions, so that no camera is gathered in memory. Frames without a camera are one
    camera's. A stream (as in :func:`stride_sample`) holds the time of each camera's last kept frame, and
    drops it once the watermark is so far on that any frame would be kept."""
    schema = frames.select("camera_id", "t", "seq").schema
    if frames.isStreaming:
        return _stateful(frames.select("camera_id", "ts", "t", "seq"), RateLimit(least_s), schema)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        camera = last = None
        for pdf in parts:
            keep = []
            for c, t in zip(pdf["camera_id"], pdf["t"], strict=True):
                c = "none" if pd.isna(c) else c
                ok = c != camera or t - last >= least_s
                if ok:
                    camera, last = c, t
                keep.append(ok)
            yield pdf[keep]

    return frames.select("camera_id", "t", "seq").repartition("camera_id").sortWithinPartitions("camera_id", "t", "seq").mapInPandas(run, schema)


def stale_urls(cameras: DataFrame, as_of: float, hours: float = 23.0) -> DataFrame:
    """Catalogue cameras whose URL is older than so many hours, or was never fetched."""
    old = F.col("fetched_t").isNull() | (F.lit(as_of) - F.col("fetched_t") >= hours * 3600)
    return cameras.filter((F.col("source_type") == "its") & old)


def video_samples(frames: DataFrame, fps: float, every: int = 1) -> DataFrame:
    """Per second of a video: sums over its frames, divided by the frames of that second."""
    rows = frames.filter(F.col("idx") % every == 0).withColumn("second", F.floor(F.col("idx") / fps))
    n = rows.groupBy("camera_id", "second").agg(F.count_distinct("idx").alias("n_frames"))
    sums = rows.groupBy("camera_id", "second", "direction_index").agg(F.sum("occupancy").alias("o"), F.sum("n_car").alias("c"))
    out = sums.join(n, ["camera_id", "second"])
    return out.select("camera_id", "second", "direction_index", F.round(F.col("o") / F.col("n_frames"), 10).alias("occupancy"), F.round(F.col("c") / F.col("n_frames"), 10).alias("n_car"), "n_frames")


def video_summary(frames: DataFrame, fps: float) -> DataFrame:
    """Duration and frames per video, and mean, maximum and exact 90th percentile per direction."""
    whole = frames.groupBy("camera_id").agg((F.floor(F.max("idx") / fps * 10 + 0.5) / 10).alias("duration_s"), F.count_distinct("idx").alias("processed"))
    per = frames.groupBy("camera_id", "direction_index").agg(F.round(F.avg("occupancy"), 10).alias("mean"), F.max("occupancy").alias("max"), F.round(F.percentile("occupancy", 0.9), 9).alias("p90"))
    return per.join(whole, "camera_id")


def episode_stream(samples: DataFrame, threshold: float, gap_s: float, least_s: float) -> DataFrame:
    """Congestion episodes of a stream of samples (camera_id, direction_index, ts, occupancy).

    A camera and direction has one open episode; a lower sample, a gap or the event-time
    timeout closes it. Cameras are dealt into ``BUCKETS``, a state each of the open episodes, so that the groups of a
    micro-batch do not grow with the cameras. Samples need a watermark on ts. Times are carried as seconds since 1970, so that
    the session's zone plays no part."""
    out = "camera_id string, direction_index string, start_t double, end_t double, peak double, mean double, samples long"
    numbers = ("start", "end", "peak", "total")
    state_type = "camera array<string>, direction array<string>, " + "".join(f"{n} array<double>, " for n in numbers) + "n array<long>, due array<long>"

    def step(key, parts, state):
        done, mark = [], state.getCurrentWatermarkMs()
        open_ = {tuple(e[:2]): list(e[2:]) for e in zip(*state.get, strict=True)} if state.exists else {}

        def close(k):
            start, end, peak, total, n, _ = open_.pop(k)
            if n >= 2 and end - start >= least_s:
                done.append((*k, start, end, peak, total / n, n))

        rows = [] if state.hasTimedOut else [r for pdf in parts for r in zip(pdf["camera"], pdf["direction"], pdf["t"], pdf["occupancy"], strict=True)]
        seen = set()
        for c, d, t, o in sorted(rows, key=lambda r: r[2:]):
            k = (c, d)
            seen.add(k)
            held = open_.get(k)
            if held and (o < threshold or t - held[1] > gap_s):
                close(k)
                held = None
            if o >= threshold:
                open_[k] = [t, t, o, o, 1, 0] if held is None else [held[0], t, max(held[2], o), held[3] + o, held[4] + 1, 0]
        for k in list(open_):
            if k in seen:
                open_[k][5] = max(int((open_[k][1] + gap_s) * 1000), mark) + 1
            elif open_[k][5] < mark or (state.hasTimedOut and open_[k][5] <= mark):
                close(k)
        if open_:
            state.update(tuple(map(list, zip(*((*k, *e) for k, e in open_.items()), strict=True))))
            state.setTimeoutTimestamp(max(min(e[5] for e in open_.values()), mark + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(done, columns=["camera_id", "direction_index", "start_t", "end_t", "peak", "mean", "samples"])

    bucket = F.pmod(F.xxhash64("camera_id", "direction_index"), F.lit(BUCKETS)).cast("int").alias("bucket")
    # as text, null stays apart from all numbers
    rows = samples.select("ts", bucket, F.col("camera_id").cast("string").alias("camera"), F.col("direction_index").cast("string").alias("direction"), (F.unix_micros("ts") / 1_000_000).alias("t"), "occupancy")
    found = rows.groupBy("bucket").applyInPandasWithState(step, out, state_type, "append", "EventTimeTimeout")
    at = lambda c: F.timestamp_micros(F.round(F.col(c) * 1_000_000).cast("long"))
    return found.select(F.col("camera_id").cast("long"), F.col("direction_index").cast("int"), at("start_t").alias("start_ts"), at("end_t").alias("end_ts"), "peak", "mean", "samples")
