"""Packing token pieces into fixed-length sequences by shortest-pack-first over a histogram.

1. Each document is encoded, ended with ``end_id`` and cut into pieces of at most ``length``
   ids; every task numbers its pieces of equal length.
2. The histogram of piece lengths (at most ``length`` rows, whatever the corpus) goes to the
   driver. Lengths are placed longest first: each goes into the shortest packs that have
   room for it, whole groups of equal packs at a time, and only pattern counts are kept.
3. Patterns are numbered into ranges of sequence ids. A piece's rank among the pieces of its
   length picks its place in a pattern by binary search over the pattern slots, whose number
   depends on ``length`` and not on the corpus; that table is broadcast.

Ranks are distributed: a window over (task, length) counts gives each task's base, so that a
length shared by a third of all pieces is never numbered in one task.

Defined results: a null or empty text gives one piece, the end id; repeated rows are packed
each; rows with null ids keep them; an empty table gives no pieces; further columns are
ignored. Texts may be of any length: long ones give many pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import Scratch
from .fragments import encoder
from .token_store import list_array, text_bytes

PIECE = [
    T.StructField("doc_id", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()),
    T.StructField("part", T.IntegerType()),
    T.StructField("rank", T.LongType()),
]
IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, length: int, doc_id, text, keep_ids: bool) -> DataFrame:
    """One row per piece, numbered among the pieces of its length in its task."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("text"))
    schema = T.StructType([*PIECE, IDS] if keep_ids else PIECE)

    def run(batches):
        from pyspark import TaskContext

        enc, part = encoder(tokenizer, "word"), TaskContext.get().partitionId()
        seen = np.zeros(length + 1, np.int64)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            keys = batch.column(0)
            for lo in range(0, batch.num_rows, 500):
                some = keys[lo : lo + 500].to_pylist()
                out, pieces = [], []
                for key, ids in zip(some, enc.encode(text_bytes(batch.column(1)[lo : lo + 500])), strict=True):
                    ids = np.concatenate([ids, end])
                    for at in range(0, len(ids), length):
                        piece = ids[at : at + length]
                        out.append((key, at, len(piece), zlib.crc32(piece.astype("<u4", copy=False)), len(ids), seen[len(piece)]))
                        seen[len(piece)] += 1
                        if keep_ids:
                            pieces.append(piece)
                cols = [pa.array([o[k] for o in out], pa.int64()) for k in range(5)]
                cols += [pa.array(np.full(len(out), part, np.int32)), pa.array([o[5] for o in out], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + [list_array(pieces)] * keep_ids, names=schema.names)

    return rows.mapInArrow(run, schema)


def shortest_pack_first(histogram: dict[int, int], length: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, count) pairs that use up ``histogram``; a pattern's lengths sum to at most ``length``.

    Each step uses up one length or one group of equal packs, so there are at most about
    twice as many patterns as lengths.
    """
    by_room: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(length + 1)]
    most = 0
    for size in sorted((n for n, k in histogram.items() if k), reverse=True):
        left = histogram[size]
        while left:
            while most and not by_room[most]:
                most -= 1
            if most < size:
                by_room[length - size].append(((size,), left))
                most, left = max(most, length - size), 0
                continue
            pattern, count = by_room[most].pop()
            used = min(left, count)
            if count > used:
                by_room[most].append((pattern, count - used))
            by_room[most - size].append(((*pattern, size), used))
            left -= used
    return [group for room in by_room for group in room]


def pattern_slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """One entry per place of a pattern: pieces of ``length`` with ranks from ``rank`` on go to
    sequences from ``sequence`` on, at ``offset``. Sorted by (length, rank)."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for pattern, count in patterns:
        at = 0
        for size in pattern:
            rows.append((size, used.get(size, 0), base, at))
            used[size] = used.get(size, 0) + count
            at += size
        base += count
    a = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"length": a[:, 0], "rank": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3]}


def find_slots(slots: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces by length and rank."""
    wide = np.int64(1) << np.int64(44)
    at = np.searchsorted(slots["length"] * wide + slots["rank"], length * wide + rank, side="right") - 1
    return slots["sequence"][at] + rank - slots["rank"][at], slots["offset"][at]


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 2,
    length: int = 4096,
    doc_id: str | Column = "doc_id",
    text: str | Column = "text",
    keep_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    and ``ids`` with ``keep_ids``. ``tokenizer`` is a ``tokenizers`` file that drops white space."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.keep(cut_pieces(docs, tokenizer, end_id, length, doc_id, text, keep_ids), "pieces")
    counts = pieces.groupBy("part", "length").count()
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}  # at most `length` rows
    slots = spark.sparkContext.broadcast(pattern_slots(shortest_pack_first(histogram, length)))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "part")
    kept = [*PIECE[:5], *([IDS] if keep_ids else [])]
    schema = T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        for b in batches:
            seq, off = find_slots(slots.value, b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(seq), pa.array(off)], names=schema.names)

    return ranked.select(*(f.name for f in kept), "rank").mapInArrow(place, schema)
