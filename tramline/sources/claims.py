"""Names that only one writer gets: files created if absent, in any file system Spark knows."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _store(spark: SparkSession, folder: str):
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(context._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    path, store = _store(spark, folder)
    return sorted(f.getPath().getName() for f in store.listStatus(path)) if store.exists(path) else []


def claim(spark: SparkSession, folder: str, name: str) -> bool:
    """Creates the empty file ``name``; false if another writer was first."""
    path, store = _store(spark, folder)
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, name)
    store.mkdirs(path)
    if store.getScheme() == "file":
        # The local file system of Spark looks first and creates then; the operating system does both at once.
        try:
            open(store.makeQualified(file).toUri().getPath(), "x").close()
        except FileExistsError:
            return False
        return True
    try:
        store.create(file, False).close()
    except Py4JJavaError:
        if not store.exists(file):
            raise
        return False
    return True


def remove(spark: SparkSession, folder: str) -> None:
    path, store = _store(spark, folder)
    store.delete(path, True)
