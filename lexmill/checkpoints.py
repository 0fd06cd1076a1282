"""Cutting a plan's lineage with tables in the folder that all executors share.

The folder is the one the session names in `spark.checkpoint.dir`; only where that is unset (tests, a single machine) a
temporary one is made. Tables survive the loss of executors, and their file sizes tell the optimizer what it may broadcast.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def shared_folder(spark: SparkSession) -> str:
    global _own
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all machines share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="spark-lexmill-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return f"file://{_own}"


class Stages:
    """Tables of one query, each under a name; a name written again replaces its older table, whose files are deleted.

    What a result still reads can't be deleted before it is read: the folder goes when the application ends, or with `clear`, which a long
    session calls once a result is written.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.paths = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}", {}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        where, fs = self._fs(self.root)
        fs.deleteOnExit(where)
        old, self.paths[name] = self.paths.get(name), path
        if old:
            self._delete(old)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                self._delete(self.paths.pop(name))

    def clear(self) -> None:
        self.paths.clear()
        self._delete(self.root)

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _delete(self, path: str) -> None:
        where, fs = self._fs(path)
        fs.delete(where, True)
