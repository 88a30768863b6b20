"""Document quality by regularised quadratic discriminant analysis.

Every whole text becomes a vector of transformed statistics (log lengths, logits of shares).
Labelled rows give each class a mean and a covariance, the latter shrunk towards the pooled
covariance and its diagonal. A text's score is the posterior of label 1: the difference of
the classes' log densities, by Mahalanobis distances over cached Cholesky factors, plus the
log odds of the classes.

Only sums (counts, vectors, matrices of the statistics' size) leave the executors.

Defined results: null and empty texts have the statistics of an empty text and a score;
repeated rows are scored each, and count in training as often as they occur; of several
labels of one id the highest counts; null labels and ids train nothing; with fewer than two
labelled rows in a class every score is the share of label 1 (0.5 without labels); an empty
table gives no rows; further columns are ignored. Texts may be of any length.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .token_store import text_bytes

FEATURES = (
    "log_bytes", "log_words", "log_word_bytes", "upper", "digits", "spaces", "line_ends", "stops", "symbols",
    "non_ascii", "symbol_kinds", "repeated_words", "repeated_lines", "entropy", "packs", "short_lines",
)


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _class("0123456789")
_STOP = _class(".,;:?'\"-()")
_SYMBOL = _class("!#$%&*+/<=>@[\\]^_`{|}~")


def _logit(share: float, n: int) -> float:
    """A share of ``n`` things on an unbounded scale; half a thing keeps the ends finite."""
    n = max(n, 1)
    k = min(max(share * n, 0.0), n)
    return math.log((k + 0.5) / (n - k + 0.5))


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one whole text, in the order of ``FEATURES``."""
    data = np.frombuffer(text, np.uint8)
    n = len(data)
    count = np.bincount(data, minlength=256)
    words, lines = text.split(), text.split(b"\n")
    m = len(words)
    share = lambda k: k / n if n else 0.0
    # shares are smoothed as of 200 things, so that long texts do not spread the scale
    scaled = lambda s: _logit(s, 200)
    p = count[count > 0] / max(n, 1)
    distinct_lines = len(set(lines))
    symbols = count[_SYMBOL]
    return [
        math.log1p(n),
        math.log1p(m),
        math.log((n + 1) / (m + 1)),
        scaled(share(int(count[_UPPER].sum()))),
        scaled(share(int(count[_DIGIT].sum()))),
        scaled(share(int(count[32]))),
        scaled(share(int(count[10]))),
        scaled(share(int(count[_STOP].sum()))),
        scaled(share(int(symbols.sum()))),
        scaled(share(int(count[128:].sum()))),
        math.log1p(int((symbols > 0).sum())),
        scaled(1 - len(set(words)) / m if m else 0.0),
        scaled(1 - distinct_lines / len(lines)),
        float(-(p * np.log2(p)).sum()),
        math.log((len(zlib.compress(text, 1)) + 1) / (n + 12)),
        scaled(sum(len(x) < 30 for x in lines) / len(lines)),
    ]


def document_statistics(docs: DataFrame, doc_id: str | Column = "doc_id", text: str | Column = "text") -> DataFrame:
    """(doc_id, x): each row's statistics."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                keys, texts = (batch.column(k)[lo : lo + 500] for k in (0, 1))
                xs = [statistics(t) for t in text_bytes(texts)]
                yield pa.RecordBatch.from_arrays([keys, pa.array(xs, pa.list_(pa.float64()))], names=schema.names)

    return docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).alias("text")).mapInArrow(run, schema)


@dataclass
class Discriminant:
    """Class means, inverse Cholesky factors, log determinants and log odds."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    log_odds: float
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        log_density = []
        for c in (0, 1):
            y = (x - self.means[c]) @ self.factors[c].T
            log_density.append(-0.5 * (y * y).sum(axis=1) - 0.5 * self.log_dets[c])
        d = np.clip(log_density[1] - log_density[0] + self.log_odds, -500, 500)
        return 1 / (1 + np.exp(-d))


def from_moments(moments: dict[int, np.ndarray], d: int, shrink: float, ridge: float) -> Discriminant:
    """The discriminant from each class's flat (count, sums, sums of products)."""
    n = {c: float(moments[c][0]) if c in moments else 0.0 for c in (0, 1)}
    if min(n.values()) < 2:
        total = n[0] + n[1]
        return Discriminant(*[np.zeros(0)] * 3, 0.0, n[1] / total if total else 0.5)
    means, scatter = [], []
    for c in (0, 1):
        mean = moments[c][1 : 1 + d] / n[c]
        means.append(mean)
        scatter.append(moments[c][1 + d :].reshape(d, d) - n[c] * np.outer(mean, mean))
    pooled = (scatter[0] + scatter[1]) / max(n[0] + n[1] - 2, 1)
    floor = np.diag(np.maximum(np.diag(pooled), 1e-6))
    factors, log_dets = [], []
    for c in (0, 1):
        own = scatter[c] / max(n[c] - 1, 1)
        cov = (1 - ridge) * ((1 - shrink) * own + shrink * pooled) + ridge * floor
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(low))
        log_dets.append(2 * np.log(np.diag(low)).sum())
    return Discriminant(np.array(means), np.array(factors), np.array(log_dets), math.log(n[1] / n[0]))


def fit(stats: DataFrame, labels: DataFrame, shrink: float = 0.3, ridge: float = 0.05) -> Discriminant:
    """Fit on ``stats`` (doc_id, x) joined with ``labels`` (doc_id, label)."""
    d = len(FEATURES)
    one = labels.filter("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    rows = stats.join(one, "doc_id").select("label", "x")

    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            y = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy().reshape(-1, d)
            for c in np.unique(y).tolist():
                z = x[y == c]
                got = np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).reshape(-1)])
                total[c] = total.get(c, 0) + got
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()])], names=["label", "m"])

    parts = rows.mapInArrow(sums, "label int, m array<double>").select("label", F.posexplode("m").alias("i", "v"))
    got = parts.groupBy("label", "i").agg(F.sum("v").alias("v")).collect()  # 1 + d + d * d sums a class
    moments = {c: np.zeros(1 + d + d * d) for c in {r[0] for r in got}}
    for c, i, v in got:
        moments[c][i] = v
    return from_moments(moments, d, shrink, ridge)


def labelled_sample(docs: DataFrame, labels: DataFrame, max_docs: int = 20_000) -> DataFrame:
    """``docs`` (doc_id, text) of at most ``max_docs`` labelled ids, in the order of a hash of the id."""
    ids = labels.filter("label is not null and doc_id is not null").select("doc_id").distinct()
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")


def score_column(text: Column, model: Discriminant) -> Column:
    """The score of each row's whole text."""

    @F.pandas_udf("double")
    def of(series: pd.Series) -> pd.Series:
        x = np.array([statistics((t or "").encode("utf-8", "surrogatepass")) for t in series]).reshape(-1, len(FEATURES))
        return pd.Series(model.score(x))

    return of(text)


def score(stats: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score) of each row of ``stats``."""
    d = len(FEATURES)
    held = stats.sparkSession.sparkContext.broadcast(model)  # a few matrices of the statistics' size

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, d)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.score(x))], names=["doc_id", "score"])

    return stats.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")
