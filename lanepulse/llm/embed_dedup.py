"""Near-duplicate embeddings by an inverted multi-index.

The halves of unit vectors are quantised by codebooks of their own; the product of the two
codebooks is a grid of cells. A vector's cells are visited in the order of the sum of its
squared distances to their two centroids (the multi-sequence order), up to a margin above its
own cell's sum. The margin is calibrated on a bounded sample so that the wanted share of
partners is reached: of the sample's true partners, and of synthetic ones that lie exactly at
the threshold, the hardest to reach. Every candidate is verified by its cosine in double
precision.

Equal vectors fall together first, so that a vector held by a third of all rows is one entry
with a weight. Cells of any size are split into chunks; a block compares a chunk of visitors
with a chunk of members as one matrix product, and emits only counts and a spanning star of
each connected group, never the pairs.

Vectors of each length are compared among themselves, with an index of their own; components keep
the precision they come in (single or double).

Defined results: vectors that are null or zero or hold null or non-finite components link with
nothing (no links, their own component, kept); repeated rows count as further vectors; with null ids a group takes its least other id; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import connected_components
from .minhash import group_runs

CHUNK = 1024


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Lloyd's centroids from distinct starting rows."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = squared_distances(x, centroids).argmin(axis=1)
        for c in range(len(centroids)):
            own = x[near == c]
            centroids[c] = own.mean(axis=0) if len(own) else x[rng.integers(len(x))]
    return centroids


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)[None, :], 0)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1. A power of two first brings the largest component near 1, which is exact, so that squares of very
    small and very large ones neither vanish nor overflow."""
    x = x.astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0, keepdims=True))[1])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@dataclass
class MultiIndex:
    first: np.ndarray
    second: np.ndarray
    margin: float

    def excess(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each half's squared distances to its centroids, above the least."""
        h = x.shape[1] // 2
        a, b = squared_distances(x[:, :h], self.first), squared_distances(x[:, h:], self.second)
        return a - a.min(axis=1, keepdims=True), b - b.min(axis=1, keepdims=True)

    def visits(self, x: np.ndarray) -> list[np.ndarray]:
        """The cells each vector visits, its own first."""
        a, b = self.excess(x)
        out, width = [], len(self.second)
        for r, s in zip(a, b, strict=True):
            i, j = np.flatnonzero(r <= self.margin), np.flatnonzero(s <= self.margin)
            total = (r[i][:, None] + s[j][None, :]).reshape(-1)
            cell = (i[:, None] * width + j[None, :]).reshape(-1)
            near = np.flatnonzero(total <= self.margin)
            out.append(cell[near[np.argsort(total[near], kind="stable")]])
        return out

    def cost(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The margin at which a visit from each ``x`` reaches the cell of its ``y``."""
        a, b = self.excess(x)
        h = y.shape[1] // 2
        i = squared_distances(y[:, :h], self.first).argmin(axis=1)
        j = squared_distances(y[:, h:], self.second).argmin(axis=1)
        at = np.arange(len(x))
        return a[at, i] + b[at, j]


def build(sample: np.ndarray, rows: int, similarity: float, recall: float, per_cell: int = 128, probes: int = 2000) -> MultiIndex:
    """Codebooks and margin from unit vectors of a sample of ``rows`` vectors."""
    k = int(np.clip(np.sqrt(rows / per_cell), 1, 256))
    h = sample.shape[1] // 2
    index = MultiIndex(kmeans(sample[:, :h], k), kmeans(sample[:, h:], k), 0.0)
    x = sample[:probes]
    rng = np.random.default_rng(9)
    side = rng.normal(size=x.shape)
    side = unit(side - (side * x).sum(axis=1, keepdims=True) * x)
    costs = [index.cost(x, similarity * x + np.sqrt(1 - similarity**2) * side)]
    for lo in range(0, len(x), 200):
        i, j = np.nonzero(x[lo : lo + 200] @ sample.T >= similarity)
        i, j = i[i + lo != j] + lo, j[i + lo != j]
        for at in range(0, len(i), 10_000):
            costs.append(index.cost(x[i[at : at + 10_000]], sample[j[at : at + 10_000]]))
    index.margin = max(float(np.quantile(c, recall)) for c in costs) + 1e-9
    return index


def _matrix(column, dtype) -> np.ndarray:
    flat = b"".join(column.to_pylist())
    return np.frombuffer(flat, dtype).reshape(len(column), -1)


def _spread(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least id that each row and each column of a bipartite graph is connected with."""
    a, b = left.copy(), right.copy()
    top = np.iinfo(np.int64).max
    while True:
        b2 = np.minimum(b, np.where(linked, a[:, None], top).min(axis=0, initial=top))
        a2 = np.minimum(a, np.where(linked, b2[None, :], top).min(axis=1, initial=top))
        if (a2 == a).all() and (b2 == b).all():
            return a, b
        a, b = a2, b2


def compare_blocks(blocks: DataFrame, similarity: float, dtype=np.float32) -> DataFrame:
    """(node, links, low) of each (cell, part, chunk) block of visitors and members."""

    def run(batches):
        for t in group_runs(batches, 3):
            cell = t.column(0)[0].as_py()
            member = t.column(3).to_numpy()
            ids, home, weight = (t.column(i).to_numpy() for i in (4, 5, 6))
            q, m = np.flatnonzero(~member), np.flatnonzero(member)
            if not len(q) or not len(m):
                continue
            x = unit(_matrix(t.column(7), dtype))
            linked = (x[q] @ x[m].T >= similarity) & (ids[q][:, None] != ids[m][None, :])
            if not linked.any():
                continue
            links = np.zeros(len(ids), np.int64)
            links[q] = linked @ weight[m]
            # a member that does not visit the visitor's cell would never see this link
            for other in np.unique(home[q]).tolist():
                if other != cell:
                    mine = home[q] == other
                    if linked[mine].any():
                        blind = np.array([other not in v for v in t.column(8).take(pa.array(m)).to_pylist()])
                        links[m] += np.where(blind, linked[mine].T @ weight[q][mine], 0)
            low = ids.copy()
            low[q], low[m] = _spread(linked, ids[q], ids[m])
            some = np.flatnonzero((links > 0) | (low != ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(low[some])], names=["node", "links", "low"])

    return blocks.mapInArrow(run, "node long, links long, low long")


def near_vectors(
    rows: DataFrame,
    vec_id: str | Column = "vec_id",
    vector: str | Column = "embedding",
    similarity: float = 0.9,
    recall: float = 0.99,
    sample_size: int = 20_000,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    spark = rows.sparkSession
    scratch = Scratch(spark, "vectors")
    v = rows.select(col(vec_id).cast("long").alias("vec_id"), col(vector).alias("v"))
    double = v.schema["v"].dataType.elementType.simpleString() != "float"
    v = v.withColumn("v", F.col("v").cast("array<double>" if double else "array<float>"))
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    zero = ~F.exists("v", lambda e: e != 0)
    v = v.withColumn("v", F.when(F.col("v").isNotNull() & ~bad & ~zero, F.col("v"))).withColumn("d", F.size("v"))
    v = v.withColumn("set_key", F.when(F.col("v").isNotNull(), F.md5(F.to_json(F.struct("v")))))
    v = scratch.keep(v, "vectors")
    out = v.filter("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    # an index for each length; an embedding table has one or a few
    for width in [r[0] for r in v.filter("v is not null").select("d").distinct().orderBy("d").collect()]:
        same = v.filter(F.col("v").isNotNull() & (F.col("d") == width))
        out = out.unionByName(_near_of_one_length(same, scratch, similarity, recall, sample_size, np.float64 if double else np.float32))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _near_of_one_length(v: DataFrame, scratch: Scratch, similarity: float, recall: float, sample_size: int, dtype) -> DataFrame:
    """(vec_id, n_links, component_id) of good vectors of one length (vec_id, v, set_key)."""
    spark = v.sparkSession
    own = v.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    groups = v.groupBy("set_key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))
    groups = scratch.keep(groups.filter("rep is not null"), "groups")
    n = groups.count()
    sample = groups.orderBy(F.xxhash64("rep"), "rep").select("v").limit(sample_size).toPandas()["v"]
    if n == 0:
        return own
    x = unit(np.array(sample.tolist(), np.float64))
    if x.shape[1] < 2:
        x = np.concatenate([x, np.zeros_like(x)], axis=1)
    held = spark.sparkContext.broadcast(build(x, n, similarity, recall))  # at most 2 * 256 centroids

    def visit(batches):
        index = held.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                b = batch.slice(lo, 2000)
                raw = b.column(2).flatten().to_numpy().reshape(b.num_rows, -1)
                x = unit(raw)
                if x.shape[1] < 2:
                    x = np.concatenate([x, np.zeros_like(x)], axis=1)
                cells = index.visits(x)
                data = [r.tobytes() for r in raw.astype(dtype)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(data, pa.binary()), pa.array(cells, pa.list_(pa.int64()))], names=["rep", "copies", "data", "cells"]
                )

    seen = groups.select("rep", "copies", "v").mapInArrow(visit, "rep long, copies long, data binary, cells array<long>")
    seen = scratch.keep(seen.withColumn("home", F.col("cells")[0]), "visits")
    visitors = seen.select(F.explode("cells").alias("cell"), F.lit(False).alias("member"), "rep", "home", "copies", "data", F.lit(None).cast("array<long>").alias("cells"))
    members = seen.select(F.col("home").alias("cell"), F.lit(True).alias("member"), "rep", "home", "copies", "data", "cells")
    # chunks of each cell's visitors and members: every visitor chunk meets every member chunk
    sizes = seen.select(F.explode("cells").alias("cell"), (F.lit(1)).alias("q"), F.lit(0).alias("m"))
    sizes = sizes.union(seen.select("home", F.lit(0), F.lit(1))).groupBy("cell").agg(F.sum("q").alias("q"), F.sum("m").alias("m")).filter("m > 0")
    pieces = lambda c: F.ceil(F.col(c) / CHUNK).cast("int")
    both = visitors.union(members).join(sizes.select("cell", pieces("q").alias("qs"), pieces("m").alias("ms")), "cell")
    mine = F.pmod(F.xxhash64("rep"), F.when(F.col("member"), F.col("ms")).otherwise(F.col("qs"))).cast("int")
    other = F.sequence(F.lit(0), F.when(F.col("member"), F.col("qs")).otherwise(F.col("ms")) - 1)
    both = both.withColumn("mine", mine).withColumn("other", F.explode(other))
    part, chunk = F.when(F.col("member"), F.col("other")).otherwise(F.col("mine")), F.when(F.col("member"), F.col("mine")).otherwise(F.col("other"))
    blocks = both.select("cell", part.alias("part"), chunk.alias("chunk"), "member", "rep", "home", "copies", "data", "cells")
    blocks = blocks.repartition("cell", "part", "chunk").sortWithinPartitions("cell", "part", "chunk")
    found = scratch.keep(compare_blocks(blocks, similarity, dtype), "found")
    component = connected_components(found.select(F.col("node").alias("a"), F.col("low").alias("b")), scratch)
    links = found.groupBy(F.col("node").alias("rep")).agg(F.sum("links").alias("links"))
    # only vectors with copies or links differ from a vector by itself
    moved = groups.select("set_key", "rep", "copies").join(links, "rep", "left").join(component.withColumnRenamed("node", "rep"), "rep", "left")
    salts = 16
    moved = moved.filter("copies > 1 or links > 0").select(
        "set_key",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
        F.coalesce("component", "rep").alias("component"),
        F.explode(F.array(*map(F.lit, range(salts)))).alias("salt"),
    )
    out = v.select("vec_id", "set_key", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("int").alias("salt"))
    out = out.join(moved, ["set_key", "salt"], "left")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
