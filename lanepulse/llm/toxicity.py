"""Toxicity by compression distance.

Two zstandard dictionaries are trained on windows (words with their leading blank) of labelled
texts: one on ordinary texts, one on the windows of toxic texts whose opening bytes are much
commoner there (by odds and a likelihood-ratio test). Each window of a text is compressed with
either dictionary, followed by a fixed carrier phrase that both hold (so that short windows
are matched at all); the difference of the two lengths says which dictionary serves it better.
On labelled texts kept out of the dictionaries, every (window length, difference) pair gets a
log likelihood ratio, and a logistic curve over a text's sum of them gives its score.

Bounds, all parameters: ``max_docs`` labelled texts of each class train the model, taken in
the order of a hash of their ids, two thirds for the dictionaries and one third for the
calibration; at most ``max_windows`` counted windows of a class reach the driver; a dictionary
trains on at most ``max_training_windows`` of them, repeated by their counts. Scoring takes
every window of every whole text; distinct windows are compressed once a worker.

Defined results: a null or empty text has no windows and the score of none; repeated rows are
scored each; of several labels of one id the highest counts; null labels and ids train
nothing; without labelled texts of both classes every score is the share of label 1 (0 without
labels); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .fragments import FragmentEncoder, cut_before_space, held
from .token_store import text_bytes

CARRIER = b"~carrier~0123456789~QWERTYUIOPASDFGHJKLZXCVBNM~"
_LENGTHS, _DIFFS, _ZERO = 16, 24, 10
BUCKETS = _LENGTHS * _DIFFS


def _window(fragment: str) -> bytes:
    word = fragment.lower().replace("\n", " ")
    return (word if word[:1] in (" ", ".", ",") else " " + word).encode("utf-8", "surrogatepass")


def _windows(texts: list[bytes]):
    """The distinct windows of each text."""
    from .fragments import _LOWER

    for t in texts:
        data = _LOWER[np.frombuffer(t, np.uint8)]
        starts = np.flatnonzero(cut_before_space(data)).tolist() if len(data) else []
        raw = data.tobytes()
        edges = sorted({0, *starts, len(raw)})
        yield {_window(raw[a:b].decode("utf-8", "replace")) for a, b in zip(edges, edges[1:], strict=False)}


def _train(samples: dict[bytes, int], size: int, limit: int) -> bytes:
    """A dictionary of at most ``size`` bytes from windows by their counts, ``limit`` of them at most, by a seeded shuffle."""
    import zstandard

    rows = [w for w in sorted(samples) for _ in range(samples[w])]
    random.Random(11).shuffle(rows)
    rows = rows[:limit]
    try:
        return zstandard.train_dictionary(size, rows).as_bytes()
    except zstandard.ZstdError:  # too few windows to train on: they are the dictionary
        return b"".join(sorted(samples, key=lambda w: (samples[w], w)))[-size:]


def _compressor(content: bytes):
    import zstandard as z

    held = z.ZstdCompressionDict(content + CARRIER, dict_type=z.DICT_TYPE_RAWCONTENT)
    params = z.ZstdCompressionParameters(
        strategy=z.STRATEGY_LAZY2, min_match=3, window_log=18, hash_log=17, chain_log=17, search_log=5, target_length=32,
        write_content_size=False, write_dict_id=False, write_checksum=False,
    )
    held.precompute_compress(compression_params=params)
    return z.ZstdCompressor(dict_data=held, compression_params=params)


@dataclass
class Distance:
    """Two dictionaries, the log likelihood ratio of each bucket, and the logistic curve."""

    ordinary: bytes
    toxic: bytes
    ratios: np.ndarray
    curve: np.ndarray
    constant: float | None = None

    def key(self) -> str:
        return hashlib.sha256(self.ordinary + b"|" + self.toxic).hexdigest()


def bucketer(model: Distance) -> FragmentEncoder:
    """This worker's lookup of windows' buckets."""

    def make() -> FragmentEncoder:
        plain, toxic = _compressor(model.ordinary), _compressor(model.toxic)

        def bucket(fragment: str) -> list[int]:
            w = _window(fragment)
            d = len(plain.compress(w + CARRIER)) - len(toxic.compress(w + CARRIER))
            return [min(len(w), _LENGTHS - 1) * _DIFFS + min(max(d + _ZERO, 0), _DIFFS - 1)]

        return FragmentEncoder(lambda fs: [bucket(f) for f in fs], cut_before_space, lower=True)

    return held(("windows", model.key()), make)


def histograms(model: Distance, texts: list[bytes]) -> np.ndarray:
    """Windows of each text by bucket."""
    out = [np.bincount(b, minlength=BUCKETS) for b in bucketer(model).encode(texts)]
    return np.array(out, np.float64).reshape(-1, BUCKETS)


def _evidence(a: int, n: int, b: int, m: int) -> float:
    """The likelihood-ratio statistic of ``a`` of ``n`` texts against ``b`` of ``m``."""
    share = (a + b) / (n + m)
    cells = ((a, n * share), (n - a, n * (1 - share)), (b, m * share), (m - b, m * (1 - share)))
    return 2 * sum(k * math.log(k / e) for k, e in cells if k)


def _density(counts: np.ndarray) -> np.ndarray:
    """Smoothed shares of the differences within each window length."""
    m = counts.reshape(_LENGTHS, _DIFFS)
    overall = (m.sum(axis=0) + 1) / (m.sum() + _DIFFS)
    return ((m + 20 * overall) / (m.sum(axis=1, keepdims=True) + 20)).reshape(-1)


def _inputs(ratio_sums: np.ndarray, windows: np.ndarray) -> np.ndarray:
    return np.stack([ratio_sums / 10, ratio_sums / np.sqrt(windows + 10), np.log1p(windows) / 10, np.ones(len(windows))], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted, lightly penalised logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        grad = x.T @ (weight * (p - y)) + 0.01 * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def predict(model: Distance, hist: np.ndarray) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(hist), model.constant)
    z = _inputs(hist @ model.ratios, hist.sum(axis=1)) @ model.curve
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_docs: int = 4000,
    max_windows: int = 400_000,
    ordinary_size: int = 65536,
    toxic_size: int = 16384,
    opening: int = 5,
    odds: float = 4.0,
    evidence: float = 20.0,
    max_training_windows: int = 200_000,
) -> Distance:
    """Fit on ``docs`` (doc_id, text) by ``labels`` (doc_id, label)."""
    spark = docs.sparkSession
    one = labels.filter("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    totals = {r[0]: r[1] for r in one.groupBy("label").count().collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1:
        return Distance(b"", b"", np.zeros(BUCKETS), np.zeros(4), n1 / (n0 + n1) if n0 + n1 else 0.0)
    ids = [one.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs) for c in (0, 1)]
    chosen = ids[0].union(ids[1]).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) == 0)
    # at most 2 * max_docs ids
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "half", "text")
    scratch = Scratch(spark, "toxicity")
    sample = scratch.keep(sample.repartition(8, "doc_id"), "sample")

    def count(batches):
        for batch in batches:
            found: Counter = Counter()
            for label, windows in zip(batch.column(0).to_pylist(), _windows(text_bytes(batch.column(1))), strict=True):
                found[label, 2, b""] += 1
                found.update((label, 0, w) for w in windows)
                found.update((label, 1, w) for w in {w[:opening] for w in windows})
            rows = [(*k, n) for k, n in found.items()]
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["label", "kind", "w", "n"])

    counted = sample.filter("not half").select("label", "text").mapInArrow(count, "label int, kind int, w binary, n long")
    counted = scratch.keep(counted.groupBy("label", "kind", "w").agg(F.sum("n").alias("n")), "counted")
    windows: list[dict[bytes, int]] = [{}, {}]
    openings: list[dict[bytes, int]] = [{}, {}]
    texts = [0, 0]
    for label in (0, 1):
        top = counted.filter(F.col("label") == label).orderBy(F.desc("kind"), F.desc("n"), "w").limit(max_windows)
        # columns and not rows: a fraction of the driver's memory
        for batch in top.select("kind", "w", "n").toArrow().to_batches(max_chunksize=20_000):
            for kind, w, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 2:
                    texts[label] = n
                else:
                    (windows if kind == 0 else openings)[label][w] = n

    def stands_out(w: bytes) -> bool:
        a, b = openings[1].get(w[:opening], 0), openings[0].get(w[:opening], 0)
        rarer = (a + 0.5) / (texts[1] + 1) >= odds * (b + 0.5) / (texts[0] + 1)
        return rarer and _evidence(a, texts[1], b, texts[0]) >= evidence

    marked = {w: n for w, n in windows[1].items() if stands_out(w)}
    model = Distance(_train(windows[0] or {b" ": 1}, ordinary_size, max_training_windows), _train(marked or {b" ": 1}, toxic_size, max_training_windows), np.zeros(BUCKETS), np.zeros(4))
    shared = spark.sparkContext.broadcast(model)  # two dictionaries of bounded size

    def spread(batches):
        for batch in batches:
            hist = histograms(shared.value, text_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(hist), pa.list_(pa.float64()))], names=["label", "h"])

    # at most max_docs rows of BUCKETS counts a class; a small fit calibrates on all it has
    base = sample.filter("half") if min(n0, n1) >= 30 else sample
    got = base.select("label", "text").mapInArrow(spread, "label int, h array<double>").toPandas()
    y = got["label"].to_numpy(np.float64)
    if not len(y) or y.min() == y.max():
        return Distance(b"", b"", np.zeros(BUCKETS), np.zeros(4), n1 / (n0 + n1))
    h = np.array(got["h"].tolist()).reshape(-1, BUCKETS)
    model.ratios = np.clip(np.log(_density(h[y == 1].sum(axis=0)) / _density(h[y == 0].sum(axis=0))), -5, 7)
    # each class weighs as in all labels
    weight = np.where(y == 1, n1 / max(y.sum(), 1), n0 / max((1 - y).sum(), 1)) / (n0 + n1) * len(y)
    model.curve = _logistic(_inputs(h @ model.ratios, h.sum(axis=1)), y, weight)
    return model


def score_column(text: Column, model: Distance) -> Column:
    """The score of each row's whole text."""

    @F.pandas_udf("double")
    def of(series: pd.Series) -> pd.Series:
        parts = []
        for lo in range(0, len(series), 500):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in series.iloc[lo : lo + 500]]
            parts.append(predict(model, histograms(model, texts) if model.constant is None else np.zeros((len(texts), 1))))
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return of(text)


def score(docs: DataFrame, model: Distance, doc_id: str | Column = "doc_id", text: str | Column = "text") -> DataFrame:
    """(doc_id, score) of each row's whole text."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                keys, texts = (batch.column(k)[lo : lo + 500] for k in (0, 1))
                m = shared.value
                p = predict(m, histograms(m, text_bytes(texts)) if m.constant is None else np.zeros((len(keys), 1)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(p)], names=["doc_id", "score"])

    return docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).alias("text")).mapInArrow(run, "doc_id long, score double")
