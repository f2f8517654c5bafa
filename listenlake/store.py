"""Intermediate tables in the folder that driver and executors share.

All tables of an application lie in one folder, which the JVM deletes at its end; ``scope`` deletes those of a step as soon as it is done.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_FOLDERS: set[str] = set()
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only on a local master where that is unset. Elsewhere that is an error: executors would each write to a disk of their own."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="listenlake-")
    return _LOCAL[app]


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def new_path(spark: SparkSession, name: str) -> str:
    folder = f"{shared_dir(spark)}/listenlake-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        fs, target = _at(spark, folder)
        fs.mkdirs(target)
        fs.deleteOnExit(target)
        _FOLDERS.add(folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once as Parquet and read it back: lineage ends here and lost executors cost no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    fs, target = _at(spark, path)
    fs.delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _at(spark, path)
    return fs.exists(target)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    fs, target = _at(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []


def mark(spark: SparkSession, path: str) -> None:
    """Put an empty file there."""
    fs, target = _at(spark, path)
    fs.create(target, True).close()


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Delete at the end the tables made within: for a step whose result is written elsewhere."""
    before = len(_MADE)
    try:
        yield
    finally:
        while len(_MADE) > before:
            remove(spark, _MADE.pop())


def clear(spark: SparkSession) -> None:
    """Delete every intermediate table of this process: for the end of a job, when its results are written."""
    while _MADE:
        remove(spark, _MADE.pop())
