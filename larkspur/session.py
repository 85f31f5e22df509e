"""Sessions, and what Python workers need to import this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def local_session(cores: str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    conf = {
        "spark.master": f"local[{cores}]",
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return on_workers(SparkSession.builder.config(map=conf).getOrCreate())


def on_workers(spark: SparkSession) -> SparkSession:
    """Puts this repository on the Python workers' path, where the session was started without it."""
    held = spark.sparkContext.environment
    path = held.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        held["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, path) if x)
    return spark
