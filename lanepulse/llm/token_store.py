"""Token ids in ORC.

Documents are encoded, ordered by id over range partitions and written as ORC: ids and
counts use ORC's integer run-length encoding, every stripe carries row indexes and Bloom
filters on ``doc_id``. Readers split files by stripe, and a lookup by id prunes stripes and
row groups by their statistics and Bloom filters before any ids are read.

File columns: ``doc_id``, ``part`` (number of the file in id order), ``row`` (place in the
file), ``local_start`` (ids before it in the file), ``n_tokens``, ``ids``.

Defined results: a null text counts as empty (its ids are the end id alone); rows with equal
ids are all kept, ordered by text; null ids come first; an empty table gives an empty store;
further columns are ignored. A document of any length is one row; batches are cut by bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .fragments import encoder

STORED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("row", T.LongType()),
        T.StructField("local_start", T.LongType()),
        T.StructField("n_tokens", T.IntegerType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
    ]
)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column's values; null is empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def list_array(pieces: list[np.ndarray], kind=pa.int32()) -> pa.Array:
    """A list column from arrays, one per row."""
    offsets = np.cumsum([0, *map(len, pieces)], dtype=np.int32)
    flat = np.concatenate(pieces) if pieces else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.astype(np.int32, copy=False), kind))


def write_ids(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 0,
    doc_id: str | Column = "doc_id",
    text: str | Column = "text",
    stripe_bytes: int = 64 << 20,
    index_stride: int = 10_000,
    bloom_fpp: float = 0.01,
) -> None:
    """Encode ``docs`` with a byte-level tokenizer file and write the ids in id order."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("text"))
    # a second key lets rows that share an id spread over partitions
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        enc, part, row, start = encoder(tokenizer, "byte"), TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], np.uint32)
        for batch in batches:
            ids = batch.column(0)
            for lo in range(0, batch.num_rows, 500):
                texts = text_bytes(batch.column(1)[lo : lo + 500])
                out = [np.concatenate([x, end]) for x in enc.encode(texts)]
                n = np.array([len(x) for x in out], np.int64)
                yield pa.record_batch(
                    [
                        ids[lo : lo + len(out)],
                        pa.array(np.full(len(out), part, np.int32)),
                        pa.array(np.arange(row, row + len(out), dtype=np.int64)),
                        pa.array(start + np.cumsum(n) - n),
                        pa.array(n.astype(np.int32)),
                        list_array(out),
                    ],
                    names=STORED.names,
                )
                row, start = row + len(out), start + int(n.sum())

    (
        rows.mapInArrow(run, STORED)
        .write.option("compression", "zstd")
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.row.index.stride", index_stride)
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", bloom_fpp)
        .orc(path)
    )


def read_ids(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The store's rows; with ``doc_ids`` a pushed-down filter prunes stripes and row groups."""
    rows = spark.read.schema(STORED).orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(doc_ids))


def part_bases(rows: DataFrame) -> DataFrame:
    """(part, base): ids in all files before each; one small row per file."""
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def crc_of_ids(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and ids_crc32: unsigned crc32 of the ids as little-endian 32-bit integers."""
    schema = T.StructType([*(rows.schema[k] for k in keep), T.StructField("ids_crc32", T.LongType())])

    def run(batches):
        for batch in batches:
            ids = batch.column(len(keep))
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            at = ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(crc, pa.int64())], names=schema.names)

    return rows.select(*keep, "ids").mapInArrow(run, schema)


def store_report(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    rows = read_ids(spark, path)
    bases = part_bases(rows.select("part", "n_tokens"))
    # one row per file: far below any broadcast limit, yet the planner decides by its size
    out = crc_of_ids(rows, "doc_id", "part", "local_start", "n_tokens").join(bases, "part")
    return out.select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), F.col("n_tokens").cast("long"), "ids_crc32"
    )
