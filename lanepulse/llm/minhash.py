"""Near-duplicate documents by banded MinHash with odd sketches and exact confirmation.

1. Each text's shingle set gives MinHash samples; bands of them are bucket keys, and all
   samples are folded into a parity bitmap (odd sketch). Texts with equal sets fall together
   at once: from here on one text stands for its set.
2. In every bucket of several sets each is paired with the least one, at first over some of the
   bands, then over all buckets that still hold several components. Odd sketches estimate the
   similarity of a pair from the population count of their XOR; pairs within reach of the
   threshold are confirmed on the full sets of both whole texts, and confirmed links are
   contracted to components.
3. Buckets that still hold several components are compared block by block, by sketches alone;
   a block emits a spanning forest of its close pairs across components, which gives
   clusters. Each cluster is cut into chunks, and a block of two chunks verifies, with the full
   sets at hand, every close pair of components that are not yet linked, emitting links only.
   So no pair that shares a bucket and passes the sketch is dropped, and neither all pairs of
   a group nor refused pairs are ever written.

A pair at the threshold of 0.85 shares no bucket with a chance of 2e-7 (26 bands of 5), and
fails the sketch with one of about 3e-6 (4.5 standard deviations).

Defined results: null, empty and wordless texts have an empty set and link with nothing;
repeated rows are kept, each linked with the others; a null id takes the component of its
set's least id, if any, and is never kept; an empty table gives no rows; further columns are
ignored. Ids name texts: rows that repeat an id repeat its text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, batches_by_bytes
from .components import connected_components
from .fragments import CHUNK, mix64
from .shingles import shingle_sets
from .token_store import text_bytes

SIGNATURE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("set_key", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("sketch", T.BinaryType()),
    ]
)
BLOCK = 512


class Sketcher:
    """MinHash band keys and odd sketches of shingle sets."""

    def __init__(self, bands: int, rows: int, bits: int):
        self.bands, self.rows, self.bits = bands, rows, bits
        rng = np.random.default_rng(4242)
        self.mul = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) | np.uint64(1)
        self.add = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
        self.fold = rng.integers(1, 2**63, rows, dtype=np.uint64) | np.uint64(1)

    def __call__(self, values: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(band keys, sketches) of the sets; all must have members."""
        n, k = len(edges) - 1, len(self.mul)
        low = np.empty((n, k), np.uint64)
        for j in range(k):
            low[:, j] = np.minimum.reduceat(values * self.mul[j] + self.add[j], edges[:-1])
        keys = mix64((low.reshape(n, self.bands, self.rows) * self.fold).sum(axis=2, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64))
        bit = mix64(low ^ (np.arange(k, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(self.bits)
        cell = np.arange(n, dtype=np.int64)[:, None] * self.bits + bit.astype(np.int64)
        odd = np.bincount(cell.reshape(-1), minlength=n * self.bits).reshape(n, self.bits) & 1
        return keys, np.packbits(odd.astype(np.uint8), axis=1)

    def reach(self, similarity: float, deviations: float) -> int:
        """The largest XOR count of sketches that a pair of this similarity shows, but for so
        many standard deviations of its MinHash samples."""
        k = len(self.mul)
        least = similarity - deviations * (similarity * (1 - similarity) / k) ** 0.5
        return int(self.bits / 2 * (1 - np.exp(-4 * k * (1 - least) / self.bits)))


def signatures(docs: DataFrame, sketcher: Sketcher, shingle: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            keys, texts = batch.column(0), text_bytes(batch.column(1))
            for lo, hi in batches_by_bytes(texts, CHUNK):
                values, edges = shingle_sets(texts[lo:hi], shingle)
                size = np.diff(edges)
                some = np.flatnonzero(size)
                bands, sketch, names = [None] * len(size), [None] * len(size), [None] * len(size)
                if len(some):
                    b, s = sketcher(values, np.append(edges[:-1][some], len(values)))
                    b = b.view(np.int64)
                    for i, at in enumerate(some.tolist()):
                        bands[at], sketch[at] = b[i], s[i].tobytes()
                        names[at] = hashlib.blake2b(values[edges[at] : edges[at + 1]].tobytes(), digest_size=16).digest()
                yield pa.RecordBatch.from_arrays(
                    [
                        keys[lo:hi],
                        pa.array(size, pa.int64()),
                        pa.array(names, pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                        pa.array(sketch, pa.binary()),
                    ],
                    names=SIGNATURE.names,
                )

    return docs.mapInArrow(run, SIGNATURE)


def xor_counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Population counts of the XOR of each row of ``a`` with each row of ``b`` (uint64 words)."""
    out = np.zeros((len(a), len(b)), np.int32)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return out


def group_runs(batches, width: int):
    """Consecutive rows with equal first ``width`` columns, as one table each (rows arrive sorted)."""
    held: list[pa.RecordBatch] = []
    name = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            this = tuple(keys[a].tolist())
            if held and this != name:
                yield pa.Table.from_batches(held)
                held = []
            name = this
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _words(column: pa.ChunkedArray) -> np.ndarray:
    flat = b"".join(column.to_pylist())
    return np.frombuffer(flat, np.uint64).reshape(len(column), -1)


def close_forest(blocks: DataFrame, reach: int) -> DataFrame:
    """(a, b) edges that connect, in each (key, left, right) block, what is within ``reach`` across
    components: one row per set. Blocks hold at most two chunks of bounded size."""

    def run(batches):
        for t in group_runs(batches, 3):
            left, right = t.column(1)[0].as_py(), t.column(2)[0].as_py()
            chunk, rep, comp = (t.column(i).to_numpy() for i in (3, 4, 5))
            words = _words(t.column(6))
            a, b = np.flatnonzero(chunk == left), np.flatnonzero(chunk == right)
            close = (xor_counts(words[a], words[b]) <= reach) & (comp[a][:, None] != comp[b][None, :])
            if not close.any():
                continue
            low = rep.copy()
            la, lb = spread(close, rep[a], rep[b])
            np.minimum.at(low, a, la)
            np.minimum.at(low, b, lb)
            some = np.unique(np.concatenate([a[close.any(axis=1)], b[close.any(axis=0)]]))
            yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(low[some])], names=["a", "b"])

    return blocks.mapInArrow(run, "a long, b long").distinct()


def spread(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least id that each row and each column of a bipartite graph is connected with."""
    a, b = left.copy(), right.copy()
    top = np.iinfo(np.int64).max
    while True:
        b2 = np.minimum(b, np.where(linked, a[:, None], top).min(axis=0, initial=top))
        a2 = np.minimum(a, np.where(linked, b2[None, :], top).min(axis=1, initial=top))
        if (a2 == a).all() and (b2 == b).all():
            return a, b
        a, b = a2, b2


def _shared_counts(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Intersection sizes of the pairs (a[i], b[j]): one by one if few, else by matrix products."""
    if len(i) < 2000:
        return np.array([len(np.intersect1d(sets[a[p]], sets[b[q]], assume_unique=True)) for p, q in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    used = np.unique(np.concatenate([a[i], b[j]])).tolist()
    flat = np.concatenate([sets[k] for k in used])
    owner = np.repeat(np.arange(len(used)), [len(sets[k]) for k in used])
    _, column = np.unique(flat, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    place = {k: n for n, k in enumerate(used)}
    ra, rb = np.array([place.get(k, 0) for k in a.tolist()]), np.array([place.get(k, 0) for k in b.tolist()])
    total = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, int(column[-1]) + 1, 4096):
        s, e = np.searchsorted(column, [lo, lo + 4096])
        m = np.zeros((len(used), 4096), np.float32)
        m[owner[s:e], column[s:e] - lo] = 1
        total += m[ra] @ m[rb].T
    return total[i, j].astype(np.int64)


def verify_clusters(blocks: DataFrame, reach: int, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) that join components within each (cluster, left, right) block of texts."""

    def run(batches):
        for t in group_runs(batches, 3):
            left, right = t.column(1)[0].as_py(), t.column(2)[0].as_py()
            chunk, rep, comp = (t.column(i).to_numpy() for i in (3, 4, 5))
            words, bodies = _words(t.column(6)), text_bytes(t.column(7))
            sets: list[np.ndarray] = []
            for lo, hi in batches_by_bytes(bodies, CHUNK):
                values, edges = shingle_sets(bodies[lo:hi], shingle)
                sets += [values[s:e] for s, e in zip(edges[:-1], edges[1:], strict=True)]
            size = np.array([len(s) for s in sets], np.int64)
            a, b = np.flatnonzero(chunk == left), np.flatnonzero(chunk == right)
            close = (xor_counts(words[a], words[b]) <= reach) & (comp[a][:, None] != comp[b][None, :])
            if left == right:
                close = np.triu(close, 1)
            i, j = np.nonzero(close)
            if not len(i):
                continue
            both = _shared_counts(sets, a, b, i, j)
            linked = (both > 0) & (100 * both >= percent * (size[a[i]] + size[b[j]] - both))
            parent: dict[int, int] = {}

            def root(x, parent=parent):
                while parent.get(x, x) != x:
                    x = parent[x]
                return x

            out = []
            for x, y in zip(a[i[linked]].tolist(), b[j[linked]].tolist(), strict=True):
                p, q = root(int(comp[x])), root(int(comp[y]))
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    out.append((int(rep[x]), int(rep[y])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out]), pa.array([o[1] for o in out])], names=["a", "b"])

    return blocks.mapInArrow(run, "a long, b long")


def _block_pairs(rows: DataFrame, key: str, size: int) -> DataFrame:
    """``rows`` (with ``n``, the rows of their key) dealt into chunks of about ``size``, each row
    once for every chunk that its own meets."""
    chunks = F.ceil(F.col("n") / size).cast("int")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("rep"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    rows = rows.withColumn("left", F.least("chunk", "other")).withColumn("right", F.greatest("chunk", "other"))
    return rows.repartition(key, "left", "right").sortWithinPartitions(key, "left", "right")


def confirm(pairs: DataFrame, texts: DataFrame, n_texts: int, shingle: int, percent: int) -> DataFrame:
    """(a, b, linked) of each pair by its full sets: 100 * intersection >= percent * union.

    Texts are dealt into blocks of about ``BLOCK`` / 2; a text travels once to each block pair
    in which it has pairs, however many these are."""
    blocks = max(1, n_texts * 2 // BLOCK)
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    pairs = pairs.select(of("a").alias("left"), of("b").alias("right"), "a", "b")
    needed = pairs.select("left", "right", F.col("a").alias("doc_id")).union(pairs.select("left", "right", "b")).distinct()
    carried = needed.join(texts, "doc_id").select("left", "right", F.col("doc_id").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    rows = carried.union(pairs.withColumn("text", F.lit(None).cast("string")))
    rows = rows.repartition("left", "right").sortWithinPartitions("left", "right")

    def run(batches):
        for t in group_runs(batches, 2):
            a, b = t.column(2).to_pylist(), t.column(3)
            is_text = b.is_null().to_numpy()
            at = np.flatnonzero(is_text).tolist()
            bodies = text_bytes(t.column(4).take(pa.array(at)))
            sets = {}
            for lo, hi in batches_by_bytes(bodies, CHUNK):
                values, edges = shingle_sets(bodies[lo:hi], shingle)
                sets |= {a[at[lo + i]]: values[edges[i] : edges[i + 1]] for i in range(hi - lo)}
            pair = np.flatnonzero(~is_text).tolist()
            x, y = [a[i] for i in pair], b.take(pa.array(pair)).to_pylist()
            linked = []
            for p, q in zip(x, y, strict=True):
                both = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
                linked.append(both > 0 and 100 * both >= percent * (len(sets[p]) + len(sets[q]) - both))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return rows.mapInArrow(run, "a long, b long, linked boolean")


def _far(x: Column, y: Column, bits: int) -> Column:
    """Population count of the XOR of two sketches."""
    word = lambda c, w: F.conv(F.hex(F.substr(c, F.lit(8 * w + 1), F.lit(8))), 16, -10).cast("long")
    return sum((F.bit_count(word(x, w).bitwiseXOR(word(y, w))) for w in range(bits // 64)), F.lit(0))


def near_duplicates(
    docs: DataFrame,
    doc_id: str | Column = "doc_id",
    text: str | Column = "text",
    shingle: int = 3,
    percent: int = 85,
    bands: int = 26,
    rows: int = 5,
    bits: int = 512,
    deviations: float = 4.5,
    broadcast_ids: int = 500_000,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    spark = docs.sparkSession
    docs = docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).alias("text"))
    scratch = Scratch(spark, "minhash")
    sketcher = Sketcher(bands, rows, bits)
    reach = sketcher.reach(percent / 100, deviations)
    sig = scratch.keep(signatures(docs, sketcher, shingle), "signatures")

    sets = sig.filter("n_shingles > 0").groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
    )
    sets = scratch.keep(sets, "sets")
    named = sets.filter("rep is not null").select("rep", "bands", "sketch")
    links = component = None

    def texts_of(ids: DataFrame) -> DataFrame:
        n = ids.count()
        ids = F.broadcast(ids) if n <= broadcast_ids else ids
        return docs.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])

    for stage in ("some bands", "all bands", "clusters"):
        # each set with its component so far
        now = named if component is None else named.join(component.withColumnRenamed("node", "rep"), "rep", "left")
        now = now.withColumn("comp", F.coalesce("component", "rep") if component is not None else F.col("rep"))
        bands_now = F.slice("bands", 1, max(1, bands // 3)) if stage == "some bands" else F.col("bands")
        keyed = now.select("rep", "comp", F.explode(bands_now).alias("key"))
        mixed = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("low"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        mixed = mixed.filter("lo <> hi").select("key", "n", "low")
        if stage != "clusters":
            pairs = keyed.join(mixed, "key").filter("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b")).distinct()
            pairs = pairs.join(now.select(F.col("rep").alias("a"), F.col("sketch").alias("x"), F.col("comp").alias("ca")), "a")
            pairs = pairs.join(now.select(F.col("rep").alias("b"), F.col("sketch").alias("y"), F.col("comp").alias("cb")), "b")
            pairs = pairs.filter((F.col("ca") != F.col("cb")) & (_far(F.col("x"), F.col("y"), bits) <= reach)).select("a", "b")
            pairs = scratch.keep(pairs, "pairs")
            ids = scratch.keep(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
            if ids.isEmpty():
                continue
            done = confirm(pairs, texts_of(ids), ids.count(), shingle, percent).filter("linked").select("a", "b")
        else:
            rest = keyed.join(mixed.select("key", "n"), "key").join(named.select("rep", "sketch"), "rep")
            rest = _block_pairs(rest, "key", BLOCK).select("key", "left", "right", "chunk", "rep", "comp", "sketch")
            forest = scratch.keep(close_forest(rest, reach), "forest")
            if forest.isEmpty():
                break
            cluster = scratch.keep(connected_components(forest, scratch).withColumnsRenamed({"node": "rep", "component": "cluster"}), "clusters")
            size = cluster.groupBy("cluster").agg(F.count("*").alias("n"))
            texts = texts_of(cluster.select(F.col("rep").alias("doc_id")))
            rest = cluster.join(size, "cluster").join(now.select("rep", "comp", "sketch"), "rep").join(texts.withColumnRenamed("doc_id", "rep"), "rep")
            rest = _block_pairs(rest, "cluster", BLOCK // 2).select("cluster", "left", "right", "chunk", "rep", "comp", "sketch", "text")
            done = verify_clusters(rest, reach, shingle, percent)
        done = scratch.keep(done, "links")
        links = done if links is None else links.union(done)
        component = scratch.keep(connected_components(links, scratch), "components")

    # only sets with several rows or a component differ from their own id
    moved = sets.select("set_key", "rep", "copies")
    if component is not None:
        moved = moved.join(component.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    else:
        moved = moved.withColumn("component", F.col("rep"))
    salts = 16
    moved = moved.filter("copies > 1 or component <> rep").select("set_key", "component", F.explode(F.array(*map(F.lit, range(salts)))).alias("salt"))
    out = sig.select("doc_id", "n_shingles", "set_key", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))
    out = out.join(moved, ["set_key", "salt"], "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
