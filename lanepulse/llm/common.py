"""What several operators need: shared folders for cut lineage, table access and the tokenizer files."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where that setting is missing and the session runs in one JVM (as in tests) a
    temporary folder stands in; on a cluster the missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "root" not in _LOCAL:
        _LOCAL["root"] = tempfile.mkdtemp(prefix="spark-lanepulse-")
        atexit.register(shutil.rmtree, _LOCAL["root"], ignore_errors=True)
    return _LOCAL["root"]


class Scratch:
    """Intermediate tables of one operator call, written once under the shared folder.

    A written table cuts lineage: a lost executor costs the reread of a file, not the
    recomputation of everything before it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/lanepulse/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return the table read back."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lanepulse_path = path
        return out

    def drop(self, *tables: DataFrame | str) -> None:
        """Delete kept tables that no later step reads."""
        for table in tables:
            path = table if isinstance(table, str) else table._lanepulse_path
            jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jpath, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer file lies (the package beside the installed libraries)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def fold_bucket(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; a null id falls in fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)), F.lit(0)).cast("int")


def batches_by_bytes(values: list[bytes], limit: int):
    """Consecutive index ranges of ``values`` of at most ``limit`` bytes each (one value at least)."""
    start = size = 0
    for i, v in enumerate(values):
        if i > start and size + len(v) > limit:
            yield start, i
            start, size = i, 0
        size += len(v)
    if start < len(values):
        yield start, len(values)
