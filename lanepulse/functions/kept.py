"""Tables written once under the folder that all executors share, and ranks over them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_LOCAL: dict[str, str] = {}


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the one that all executors share (``spark.checkpoint.dir``); a local
    session without that setting uses a temporary one, removed at its end."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if "root" not in _LOCAL:
            _LOCAL["root"] = tempfile.mkdtemp(prefix="spark-lanepulse-")
            atexit.register(shutil.rmtree, _LOCAL["root"], ignore_errors=True)
        root = _LOCAL["root"]
    return f"{root.rstrip('/')}/lanepulse/{name}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written as Parquet and read back: later steps neither recompute them nor carry their plan."""
    path = work_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    out = rows.sparkSession.read.schema(rows.schema).parquet(path)
    out._kept_path = path
    return out


def spent(*tables: DataFrame) -> None:
    """Deletes tables of :func:`kept` that no later step reads."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._kept_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def ranked(rows: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """``rows`` with their number in ``order`` from 1, which should leave no ties: numbered within range partitions,
    to which the counts of those before are added, so that no task sees all rows."""
    parts = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    parts = kept(parts, "ranked")
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_local", local).join(F.broadcast(counts), "_part").withColumn(name, F.col("_before") + F.col("_local")).drop("_part", "_local", "_before")
