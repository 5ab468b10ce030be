"""Folders for intermediate tables, on the storage that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def top_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else the folder of the session's checkpoints. Where neither is set, a temporary folder of a
    session that has one machine alone; on a cluster, where executors don't see each other's folders, an error."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if top:
        return top.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + tempfile.gettempdir()


#: How tables are written whose rows hold packs of others. A writer looks at what it holds after a hundred rows by default, and a
#: scan holds up to 4,096 rows of a row group at once: both are so many bytes here, and a row.
GROUP = 1 << 22
SMALL_GROUPS = {"parquet.block.size": str(GROUP), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}

#: Folders of intermediate tables that this program has named.
_named: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below the shared folder."""
    _named.append(f"{top_folder(spark)}/pagewright-{uuid.uuid4().hex}")
    return _named[-1]


def release(spark: SparkSession) -> int:
    """Deletes the intermediate tables that this program has written so far, and returns how many there were. For a program
    that has written its results: frames that the operators returned before read these tables, and can't be used any more."""
    gone = 0
    while _named:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_named.pop())
        gone += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of intermediate tables that no frame in use reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(rows: DataFrame, packs: bool = False) -> DataFrame:
    """The rows, computed once and read back: a lost executor costs a retry, and later steps see a scan. ``packs``: rows are
    large."""
    folder = shared_folder(rows.sparkSession)
    rows.write.options(**(SMALL_GROUPS if packs else {})).parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)
