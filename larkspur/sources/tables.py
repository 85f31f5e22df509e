"""The six tables on disk, and what stands in for a missing one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.schemas import TABLE_DDL, table_schema


class NotBuilt(RuntimeError):
    """A required table isn't there; the build has to run first."""


def file_system(spark: SparkSession, path: str):
    """(file system, path) of the cluster's own kind, so that any store it knows will do."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it isn't there."""
    fs, at = file_system(spark, path)
    return sorted(e.getPath().getName() for e in fs.listStatus(at) if e.isDirectory()) if fs.exists(at) else []


def migrated(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the table's columns in order; those an older build lacks are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table_schema(name)])


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], table_schema(name))


def require(spark: SparkSession, root: str, name: str) -> DataFrame:
    path = f"{root}/{name}"
    if not exists(spark, path):
        raise NotBuilt(f"{name} isn't in {root}: build the tables first")
    return migrated(spark.read.schema(table_schema(name)).parquet(path), name)  # columns an older build lacks are null


def read_or_empty(spark: SparkSession, root: str, name: str) -> DataFrame:
    return require(spark, root, name) if exists(spark, f"{root}/{name}") else empty(spark, name)


def write(df: DataFrame, root: str, name: str) -> None:
    """Always writes, an empty table too, so that no older one stays. Latest rows have a folder of their own, and names are sorted within files."""
    by = [c for c in ("package_name", "component_name", "export_name") if c in df.columns]
    migrated(df, name).sortWithinPartitions(*by or ["project_id"]).write.mode("overwrite").partitionBy("is_latest").parquet(f"{root}/{name}")


@dataclass
class Tables:
    """The six tables as DataFrames."""

    project_snapshots: DataFrame
    dependencies: DataFrame
    component_usages: DataFrame
    component_prop_usages: DataFrame
    function_usages: DataFrame
    function_arg_usages: DataFrame

    @classmethod
    def read(cls, spark: SparkSession, root: str, optional: bool = True) -> Tables:
        """``optional``: tables other than project_snapshots may be missing."""
        load = lambda n: read_or_empty(spark, root, n) if optional and n != "project_snapshots" else require(spark, root, n)
        return cls(**{n: load(n) for n in TABLE_DDL})

    def latest(self, name: str) -> DataFrame:
        return getattr(self, name).filter("is_latest")
