"""Shared plumbing of the training-data operators: the shared work folder, tables, hashing.

Every intermediate result that must outlive one job is written under the folder that
``spark.checkpoint.dir`` names (shared by driver and executors), never into a
machine-local temporary folder.  Only where that setting is absent (unit tests on one
machine) a folder of our own is chosen.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlab.session import ship

#: Arrow batches stay small, in rows and in bytes, because single texts can be very long.
ARROW_ROWS, ARROW_BYTES = 256, 4 << 20


def session(df: DataFrame) -> SparkSession:
    """The frame's session, with Arrow batches bounded for long texts."""
    spark = ship(df.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="claimlab-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def posix_path(path: str) -> str:
    """The mounted path of a shared folder, for code that maps files into memory."""
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return unquote(parts.path)
    raise ValueError(f"{path}: memory-mapped files need a shared folder that is mounted (file:)")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a frame into the shared folder and read it back: cuts lineage and survives
    the loss of executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._scratch_path = path
    return written


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    hadoop, files = _file_system(spark, path)
    return files.exists(hadoop)


def discard(*frames: DataFrame) -> None:
    """Delete materialised frames that nothing reads any more."""
    for frame in frames:
        hadoop, files = _file_system(frame.sparkSession, frame._scratch_path)
        files.delete(hadoop, True)


def drop_shuffle_files(spark: SparkSession) -> None:
    """Spark drops the shuffle files of plans that the driver's JVM has collected: ask it
    to collect, where jobs that shuffle whole texts are over."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def unused(frame: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of the frame has, in any case."""
    taken = {c.lower() for c in frame.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the rows whose labels may never be learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == 0


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
