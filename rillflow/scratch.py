"""Tables written to the folder that the cluster shares, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a new temporary one only where it is unset and the master is local."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='rillflow-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_WRITTEN: list[str] = []
#: The path of each written table that is still held.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: Whether Spark deletes the shuffles of a query when it has ended.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_path(spark: SparkSession, name: str) -> str:
    _WRITTEN.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def clear(spark: SparkSession) -> int:
    """Deletes what this process has written to the shared folder, and tells how many paths that were.

    Results that still read such tables must be written before.
    """
    hadoop, gone = spark._jvm.org.apache.hadoop.fs.Path, 0
    while _WRITTEN:
        path = hadoop(_WRITTEN.pop())
        gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def _read(df: DataFrame, path: str) -> DataFrame:
    """The table at path, whose rows are of df's kind."""
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


def drop(*written: DataFrame) -> None:
    """Deletes what saved, saved_few or saved_parts returned, once nothing that reads it is left to run; other tables stay."""
    for df in written:
        if path := _PATHS.pop(df, None):
            hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)
            if path in _WRITTEN:
                _WRITTEN.remove(path)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back: a lost executor costs no earlier stage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return _read(df, path)


def saved_few(df: DataFrame, name: str) -> DataFrame:
    """saved, for rows of a few bytes behind a shuffle: a file for eight of its partitions (but one for each core).

    On local file systems each new file or folder starts a process of the executor's size for an instant.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return saved(df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, partitions // 8)), name)


def saved_parts(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """Tables of one kind, at least one, written one after the other as one table and read back.

    The shuffles that made a part are deleted when it is written, so the disk holds those of one part at a time.
    """
    path = None
    for df in parts:
        conf, path = df.sparkSession.conf, path or new_path(df.sparkSession, name)
        before = conf.get(_FREE, "false")
        conf.set(_FREE, "true")
        try:
            df.write.mode("append").parquet(path)
        finally:
            conf.set(_FREE, before)
    return _read(df, path)
