"""Intermediate tables in the folder that all executors share.

A table written there survives the loss of any executor, cuts the lineage of an
iterative job, and is read again column by column.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; in local mode without one, a folder that goes at the end."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="larkspur-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        named = f"file://{folder}"
        spark.sparkContext.setCheckpointDir(named)
    return named


def _gone(folder, path) -> None:
    try:
        folder.delete(path, True)
        folder.delete(path.getParent(), False)  # only if it is empty
    except Exception:  # noqa: BLE001 - the JVM has ended already, or other tables are still there
        pass


class Scratch:
    """``with Scratch(spark) as s``: ``s.write`` makes a table that goes at the end, ``s.keep`` one that goes when the
    driver's Python ends.

    >>> with Scratch(spark) as s:
    ...     a = s.write(df)
    ...     result = s.keep(a.groupBy("k").count())
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.tables = spark, f"{shared_dir(spark)}/larkspur-{uuid.uuid4().hex}", []

    def __enter__(self) -> Scratch:
        return self

    def _put(self, df: DataFrame, path: str) -> DataFrame:
        held = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")  # what is written needs its shuffle files no more
        try:
            df.write.parquet(path)
        finally:
            if held is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, held)
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def write(self, df: DataFrame) -> DataFrame:
        self.tables.append(f"{self.root}/{len(self.tables)}")
        return self._put(df, self.tables[-1])

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/kept-{uuid.uuid4().hex}"
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        atexit.register(_gone, folder, at)  # results are read lazily, so not before the driver ends
        return self._put(df, path)

    def __exit__(self, *_: object) -> None:
        for path in self.tables:
            self._delete(path)
