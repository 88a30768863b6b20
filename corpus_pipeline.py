"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept;
its result is written as Parquet and read again as the next one's documents. All stages but the
last return the columns of documents, whatever other columns they have.

Defined results: null texts are scored, packed and compared as empty ones; line dedup makes them empty; rows
that repeat an id or have none are documents of their own; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanepulse.llm import line_dedup, minhash, packing, quality, toxicity
from lanepulse.llm.common import Scratch, fold_bucket, table, tokenizer_path

THRESHOLD = 0.3
BROADCAST_IDS = 500_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality discriminant keeps. Labels serve its training alone."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    labels = labels.filter(fold_bucket(F.col("doc_id"), 5) != 0)
    model = quality.fit(quality.document_statistics(quality.labelled_sample(docs, labels)), labels)
    return docs.filter(quality.score_column(F.col("text"), model) >= THRESHOLD)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression distance does not find toxic."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs, labels.filter(fold_bucket(F.col("doc_id"), 4) != 2))
    return docs.filter(toxicity.score_column(F.col("text"), model) < THRESHOLD)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that occur before; one that loses its whole text goes."""
    out = line_dedup.dedup_lines(docs)
    removed = F.col(out.columns[-1])  # by whatever name it has beside the input's columns
    out = out.filter((removed == 0) | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by doc_id (rows without one last), of each group of near duplicates:
    texts whose sets of five-word shingles have a similarity of 0.8. Rows are told apart by a
    number that is written with them, so that rows without an id and rows that repeat one
    count as documents. 38 bands keep the chance that a pair at 0.8 shares no bucket at 3e-7."""
    scratch, columns = Scratch(spark, "near"), docs.columns
    # names of their own, whatever the input's are
    docs = scratch.keep(docs.toDF(*(f"c{i}" for i in range(len(columns)))).withColumn("_row", F.monotonically_increasing_id()), "rows")
    doc_id, text = (f"c{columns.index(c)}" for c in ("doc_id", "text"))
    found = minhash.near_duplicates(docs, "_row", text, shingle=5, percent=80, bands=38)
    lost = scratch.keep(found.filter("not kept").select(F.col("doc_id").alias("_row"), "component_id"), "lost")
    member = lost.union(lost.select("component_id", "component_id").distinct())
    order = F.struct(F.col(doc_id).isNull(), F.col(doc_id), F.col("_row").alias("_row"))
    first = docs.select("_row", doc_id).join(member, "_row").groupBy("component_id").agg(F.min(order).getField("_row").alias("_row"))
    first = scratch.keep(first, "first")
    gone = lost.join(first, "_row", "left_anti").select("_row").union(first.filter("_row <> component_id").select("component_id"))
    gone = scratch.keep(gone, "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(gone, "_row", "left_anti").drop("_row").toDF(*columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their ids, packed into sequences of 4096 tokens."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("packing", packing_stage),
]

#: The stages use classifiers, hashes and tokenizers that SQL lacks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
