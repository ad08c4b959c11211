"""Work folders: intermediate tables that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Folders that this process has made: what ``remove_work`` clears.
_made: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in ``spark.checkpoint.dir``; a temporary one only where a local session leaves that unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="victual-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def remove_work() -> int:
    """Delete the work folders made so far, once what was read from them is written elsewhere or not needed; how many."""
    for path, spark in (gone := dict(_made)).items():
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        del _made[path]
    return len(gone)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, computed once: written to a work folder and read again."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path without its scheme where it's one of the machines' own file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = at.makeQualified(files.getUri(), files.getWorkingDirectory()).toUri()
    return whole.getPath() if whole.getScheme() == "file" else None


@contextmanager
def session_settings(spark: SparkSession, settings: dict[str, int]) -> Iterator[None]:
    """Settings of the session for what runs within, as Spark has none for a single read."""
    before = {key: spark.conf.get(key) for key in settings}
    for key, now in settings.items():
        spark.conf.set(key, str(now))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
