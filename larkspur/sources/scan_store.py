"""The store of scan documents: one JSON file for each scan, in a ``scans`` folder of its project."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.schemas import SCAN_DDL, scan_schema
from larkspur.sources.tables import file_system

DEPTH, BUILT = 8, "built"


def discover(spark: SparkSession, root: str) -> list[str]:
    """The scan folders below ``root``, at most ``DEPTH`` deep and outside of built tables; unreadable ones are passed over."""
    fs, at = file_system(spark, root)
    found, level = [], [at]
    for _ in range(DEPTH + 1):
        below = []
        for folder in level:
            try:
                entries = list(fs.listStatus(folder)) if fs.exists(folder) else []
            except Exception:  # noqa: BLE001, S112  an unreadable folder
                continue
            below += [e.getPath() for e in entries if e.isDirectory() and e.getPath().getName() != BUILT]
        found += [str(p) for p in below if p.getName() == "scans"]
        level = below
    return sorted(found)


def read_scans(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(scans, paths of files that hold no valid document). Only ``*.json`` directly in a scans folder counts."""
    folders = discover(spark, root)
    schema = scan_schema().add("_corrupt", "string")
    if not folders:
        return spark.createDataFrame([], scan_schema()), spark.createDataFrame([], "path string")
    reader = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", "*.json")
    docs = reader.json(folders).withColumn("_path", F.col("_metadata.file_path"))
    bad = F.col("_corrupt").isNotNull() | (F.col("id").isNull() & F.col("scannedAt").isNull())
    return docs.filter(~bad).drop("_corrupt", "_path"), docs.filter(bad).select(F.col("_path").alias("path"))


def _write(fs, path, text: str) -> None:
    out = fs.create(path, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


class ScanStore:
    """Documents of one project: saving one of a known commit replaces it."""

    def __init__(self, spark: SparkSession, root: str, slug: str):
        self.spark, self.folder = spark, f"{root.rstrip('/')}/{slug}"
        self.fs, _ = file_system(spark, root)

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def save(self, document: dict, latest: bool = True) -> str:
        """Writes a document; ``latest`` also makes it the newest (not so for history)."""
        text = json.dumps(document, indent=2)
        _write(self.fs, self._path(f"scans/{document['id']}.json"), text)
        if latest:
            _write(self.fs, self._path("latest.json"), text)
        return f"{self.folder}/scans/{document['id']}.json"

    def _load(self, name: str) -> dict | None:
        path = self._path(name)
        if not self.fs.exists(path):
            return None
        rows = self.spark.read.text(str(path), wholetext=True).collect()
        try:
            return json.loads(rows[0][0]) if rows else None
        except ValueError:
            return None

    def load_latest(self) -> dict | None:
        return self._load("latest.json")

    def load(self, scan_id: str) -> dict | None:
        return self._load(f"scans/{scan_id}.json")

    def list(self) -> list[str]:
        folder = self._path("scans")
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        return sorted(n.removesuffix(".json") for n in names if n.endswith(".json"))

    def has(self, commit: str) -> bool:
        return self.fs.exists(self._path(f"scans/{commit}.json"))


def missing_commits(commits: DataFrame, scans: DataFrame) -> DataFrame:
    """Commits (project_id, sha) of which no document is stored."""
    return commits.join(scans.select("project_id", "sha"), ["project_id", "sha"], "left_anti")


__all__ = ["SCAN_DDL", "ScanStore", "discover", "missing_commits", "read_scans"]
